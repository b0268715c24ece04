"""Label ledgers, ground truth, triage queues and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.functions import text as tx
from trajlens.functions.taxonomy import failure_types
from trajlens.operators import labels as lb
from trajlens.plans.registry import query
from trajlens.plans.sqltext import LR, b1
from trajlens.sources import bind

AUTH = "CASE label_status WHEN 'adjudicated' THEN 4 WHEN 'human_reviewed' THEN 3 WHEN 'auto_labeled' THEN 2 ELSE 1 END"
CANON = LR + """, fu AS (SELECT left(session_id, 8) AS short, count(*) AS n, max(session_id) AS only_id
   FROM (SELECT DISTINCT session_id FROM lr WHERE length(session_id) > 8) GROUP BY 1),
rc AS (SELECT lr.*, CASE WHEN n = 1 THEN only_id ELSE session_id END AS canonical_id, coalesce(n > 1, false) AS ambiguous FROM lr LEFT JOIN fu ON session_id = short)"""
GT = CANON + f""", ra AS (SELECT *, {AUTH} AS auth FROM rc),
best AS (SELECT * FROM ra QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY auth DESC, seq) = 1),
clean AS (SELECT canonical_id FROM best WHERE auth >= 3 AND annotator_type IN ('human', 'adjudicated') AND NOT has_failure),
gt AS (SELECT canonical_id AS session_id, code, onset_step, is_latent, label_status = 'auto_labeled' AS is_draft FROM ra
   WHERE has_failure AND auth >= 2 AND code <> '' AND canonical_id NOT IN (SELECT canonical_id FROM clean)
   QUALIFY row_number() OVER (PARTITION BY canonical_id, code ORDER BY auth DESC, seq) = 1)"""


def records(spark, sf_dir):
    return bind.label_records(spark, sf_dir).drop("user_id")


@query("ground_truth", f"WITH {GT} SELECT * FROM gt")
def ground_truth(spark, sf_dir):
    return lb.ground_truth(records(spark, sf_dir))


@query("canonical_ids", f"WITH {CANON} SELECT canonical_id, count(DISTINCT session_id) AS ids, bool_or(ambiguous) AS ambiguous FROM rc GROUP BY 1")
def canonical_ids(spark, sf_dir):
    return lb.canonical_ids(records(spark, sf_dir))


@query("best_labels", f"""WITH {LR} SELECT session_id, annotator_type, annotator_id, has_failure, code, seq FROM lr
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY CASE annotator_type WHEN 'adjudicated' THEN 4 WHEN 'human' THEN 3 WHEN 'auto' THEN 2 ELSE 1 END DESC, seq) = 1""")
def best_labels(spark, sf_dir):
    return lb.best_labels(records(spark, sf_dir)).select("session_id", "annotator_type", "annotator_id", "has_failure", "code", "seq")


@query("ledger_upsert", f"""WITH {LR} SELECT session_id, annotator_type, annotator_id, updated_at, code, seq FROM lr
QUALIFY row_number() OVER (PARTITION BY session_id, annotator_type, annotator_id ORDER BY updated_at DESC, seq DESC) = 1""")
def ledger_upsert(spark, sf_dir):
    """Two ledgers merged by their record key, the newer record of each key kept."""
    every = records(spark, sf_dir).select("session_id", "annotator_type", "annotator_id", "updated_at", "code", "seq")
    old, new = every.where("seq % 2 = 0"), every.where("seq % 2 = 1")
    return lb.latest(old.unionByName(new), ["session_id", "annotator_type", "annotator_id"], "updated_at", "seq")


SIDE = LR + """, nw AS (SELECT * FROM lr QUALIFY row_number() OVER (PARTITION BY session_id, annotator_type ORDER BY updated_at DESC, seq DESC) = 1),
dp AS (SELECT s.session_id, """ + ", ".join(
    f"CASE WHEN {a}.seq IS NOT NULL AND {b}.seq IS NOT NULL THEN {a}.has_failure <> {b}.has_failure OR {a}.code <> {b}.code END AS {n}"
    for n, a, b in (("detector_auto", "d", "a"), ("auto_human", "a", "h"), ("human_adjudicated", "h", "j"), ("detector_human", "d", "h"))) + """,
   CASE WHEN a.seq IS NOT NULL AND h.seq IS NOT NULL THEN CASE WHEN a.onset_step <> 0 AND h.onset_step <> 0 THEN abs(a.onset_step - h.onset_step) ELSE 0 END END AS onset_delta,
   abs(a.severity - h.severity) AS severity_delta FROM (SELECT DISTINCT session_id FROM lr) s
   LEFT JOIN nw d ON d.session_id = s.session_id AND d.annotator_type = 'detector' LEFT JOIN nw a ON a.session_id = s.session_id AND a.annotator_type = 'auto'
   LEFT JOIN nw h ON h.session_id = s.session_id AND h.annotator_type = 'human' LEFT JOIN nw j ON j.session_id = s.session_id AND j.annotator_type = 'adjudicated'),
dg AS (SELECT *, coalesce(detector_auto::INT, 0) + coalesce(auto_human::INT, 0) + coalesce(human_adjudicated::INT, 0) + coalesce(detector_human::INT, 0) AS total_disagreements FROM dp)"""


@query("layer_disagreements", f"WITH {SIDE} SELECT * FROM dg")
def layer_disagreements(spark, sf_dir):
    return lb.disagreements(lb.layers(records(spark, sf_dir)))


@query("annotation_queue", f"""WITH {SIDE}, pc AS (SELECT code, count(*) AS n FROM lr WHERE has_failure AND code <> '' GROUP BY code),
nv AS (SELECT session_id, max(CASE WHEN n <= 2 THEN 5.0 WHEN n <= 5 THEN 2.0 ELSE 0.0 END) AS novelty FROM lr JOIN pc USING (code) WHERE has_failure GROUP BY session_id),
ps AS (SELECT session_id, bool_or(label_status = 'adjudicated') AS done, coalesce(max(severity) FILTER (WHERE has_failure), 0) * 2.0 AS severity,
   coalesce((5 - min(confidence) FILTER (WHERE confidence > 0)) * 2.0, 6.0) AS uncertainty,
   CASE WHEN bool_or(annotator_type IN ('human', 'adjudicated')) THEN 0.0 ELSE 4.0 END AS unreviewed FROM lr GROUP BY session_id)
SELECT session_id, CAST(severity AS DOUBLE) AS severity, CAST(uncertainty AS DOUBLE) AS uncertainty, CAST(total_disagreements * 3.0 AS DOUBLE) AS disagreement,
  CAST(coalesce(novelty, 0.0) AS DOUBLE) AS novelty, CAST(unreviewed AS DOUBLE) AS unreviewed,
  CAST(severity + uncertainty + total_disagreements * 3.0 + coalesce(novelty, 0.0) + unreviewed AS DOUBLE) AS score
FROM ps JOIN dg USING (session_id) LEFT JOIN nv USING (session_id) WHERE NOT done ORDER BY score DESC, session_id LIMIT 50""")
def annotation_queue(spark, sf_dir):
    return lb.priority_queue(records(spark, sf_dir), 50)


@query("record_issues", f"""WITH {LR} SELECT session_id, seq, concat_ws('; ', CASE WHEN has_failure AND code = '' THEN 'failure without code' END,
  CASE WHEN has_failure AND severity NOT BETWEEN 1 AND 5 THEN 'severity out of range' END,
  CASE WHEN has_failure AND confidence NOT BETWEEN 1 AND 5 THEN 'confidence out of range' END) AS issues FROM lr
WHERE has_failure AND (code = '' OR severity NOT BETWEEN 1 AND 5 OR confidence NOT BETWEEN 1 AND 5)""")
def record_issues(spark, sf_dir):
    return lb.issues(records(spark, sf_dir), [c for c in bind.CODES if c])


@query("ledger_quality", f"""WITH {CANON}, p AS (SELECT canonical_id, count(*) AS n, bool_and(annotator_type = 'detector') AS d,
  bool_or(label_status IN ('human_reviewed', 'adjudicated') AND NOT has_failure) AS c, bool_or(label_status IN ('human_reviewed', 'adjudicated') AND has_failure) AS b,
  bool_or(label_status = 'auto_labeled') AS dr, bool_or(label_status IN ('human_reviewed', 'adjudicated')) AS t, count(DISTINCT session_id) AS ids,
  count(*) FILTER (WHERE label_status IN ('human_reviewed', 'adjudicated')) AS rv FROM rc GROUP BY 1),
cc AS (SELECT code, count(*) AS m FROM rc WHERE has_failure AND canonical_id NOT IN (SELECT canonical_id FROM p WHERE c) GROUP BY code)
SELECT sum(rv) < 10 AS low_sample, (SELECT CASE WHEN max(m) > 0.5 * sum(m) THEN arg_max(code, m) END FROM cc) AS imbalanced_code, CAST(sum(n) AS BIGINT) AS records, count(*) AS sessions, count(*) FILTER (WHERE d) AS detector_only, count(*) FILTER (WHERE c AND b) AS conflicting,
  count(*) FILTER (WHERE dr AND NOT t) AS draft_only, count(*) FILTER (WHERE ids > 1) AS mixed_ids, count(*) FILTER (WHERE t) AS trusted FROM p""")
def ledger_quality(spark, sf_dir):
    return lb.quality_report(records(spark, sf_dir))


@query("ledger_stats", f"""WITH {LR} SELECT 'annotator' AS kind, annotator_type AS name, count(*) AS n FROM lr GROUP BY ALL
UNION ALL SELECT 'status', label_status, count(*) FROM lr GROUP BY ALL UNION ALL SELECT 'code', code, count(*) FROM lr WHERE has_failure GROUP BY ALL""")
def ledger_stats(spark, sf_dir):
    return lb.ledger_stats(records(spark, sf_dir))


@query("label_filters", f"""WITH {LR} SELECT session_id, count(*) FILTER (WHERE label_status = 'adjudicated') AS gold,
  count(*) FILTER (WHERE label_status IN ('adjudicated', 'human_reviewed')) AS trainable,
  count(*) FILTER (WHERE label_status IN ('adjudicated', 'held_out_test')) AS evaluation,
  count(*) FILTER (WHERE NOT is_latent) AS observable, bool_and(annotator_type = 'detector') AS is_unlabeled FROM lr GROUP BY session_id""")
def label_filters(spark, sf_dir):
    def n(c):
        return F.count(F.when(c, 1))
    s = F.col("label_status")
    return records(spark, sf_dir).groupBy("session_id").agg(
        n(s == "adjudicated").alias("gold"), n(s.isin(*lb.TRUSTED)).alias("trainable"),
        n(s.isin("adjudicated", "held_out_test")).alias("evaluation"), n(~F.col("is_latent")).alias("observable"),
        F.bool_and(F.col("annotator_type") == "detector").alias("is_unlabeled"))


@query("unlabeled_sessions", f"""WITH {LR} SELECT DISTINCT session_id FROM lr WHERE session_id NOT IN (SELECT session_id FROM lr WHERE annotator_type = 'adjudicated' AND has_failure)""")
def unlabeled_sessions(spark, sf_dir):
    r = records(spark, sf_dir)
    labelled = r.where((F.col("annotator_type") == "adjudicated") & F.col("has_failure")).select("session_id")
    return r.select("session_id").distinct().join(labelled, "session_id", "left_anti")


@query("ledger_merge", f"""WITH {LR}, o AS (SELECT session_id, arg_max(code, seq) AS code, max(seq) AS seq FROM lr WHERE annotator_type = 'detector' GROUP BY 1),
n AS (SELECT session_id, arg_max(code, seq) AS code, max(seq) AS seq FROM lr WHERE annotator_type = 'adjudicated' GROUP BY 1)
SELECT session_id, coalesce(n.code, o.code) AS code, CASE WHEN o.seq IS NULL THEN 'added' WHEN n.seq IS NULL THEN 'kept' ELSE 'replaced' END AS action
FROM o FULL JOIN n USING (session_id)""")
def ledger_merge(spark, sf_dir):
    r = records(spark, sf_dir)
    def side(layer, name):
        return r.where(F.col("annotator_type") == layer).groupBy("session_id").agg(F.max_by("code", "seq").alias(name))
    both = side("detector", "old").join(side("adjudicated", "new"), "session_id", "full_outer")
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept").otherwise("replaced")
    return both.select("session_id", F.coalesce("new", "old").alias("code"), action.alias("action"))


CASES = b1() + """, cs AS (SELECT session_id, event_id AS seq, (['stall', 'error_cascade', 'context_loss'])[k % 3 + 1] AS failure,
  CASE WHEN k % 10 = 0 THEN 'critical' ELSE 'warning' END AS severity, round(k / 100.0, 2) AS confidence, step,
  CASE WHEN event_type = 'view' THEN 'confirmed' WHEN event_type = 'click' THEN 'false_positive' ELSE 'predicted' END AS status FROM b1),
fp AS (SELECT failure, count(*) FILTER (WHERE status = 'false_positive') AS false_positive, count(*) FILTER (WHERE status = 'confirmed') AS confirmed,
  count(*) FILTER (WHERE status = 'predicted') AS predicted, round(count(*) FILTER (WHERE status = 'false_positive')
    / nullif(count(*) FILTER (WHERE status IN ('false_positive', 'confirmed')), 0), 6) AS fp_rate FROM cs GROUP BY failure)"""


def cases(spark, sf_dir):
    ev = bind.events(spark, sf_dir)
    names = F.array(F.lit("stall"), F.lit("error_cascade"), F.lit("context_loss"))
    status = (F.when(F.col("event_type") == "view", "confirmed").when(F.col("event_type") == "click", "false_positive")
              .otherwise("predicted"))
    return ev.df.select("session_id", F.col("event_id").alias("seq"), F.element_at(names, (F.col("k") % 3 + 1).cast("int")).alias("failure"),
                        F.when(F.col("k") % 10 == 0, "critical").otherwise("warning").alias("severity"),
                        F.round(F.col("k") / 100.0, 2).alias("confidence"), "step", status.alias("status"))


@query("promoted_cases", f"""WITH {CASES} SELECT session_id, failure, seq, severity, status FROM (SELECT *, min(seq) OVER (PARTITION BY session_id, failure) AS f FROM cs)
WHERE seq = f OR severity = 'critical'""")
def promoted_cases(spark, sf_dir):
    return lb.promoted(cases(spark, sf_dir)).select("session_id", "failure", "seq", "severity", "status")


@query("false_positive_rates", f"WITH {CASES} SELECT * FROM fp")
def false_positive_rates(spark, sf_dir):
    return lb.false_positive_rates(cases(spark, sf_dir))


@query("discounted_confidence", f"""WITH {CASES} SELECT session_id, seq, failure, round(confidence * (1 - 0.5 * coalesce(fp_rate, 0.0)), 4) AS adjusted
FROM cs LEFT JOIN fp USING (failure) WHERE status = 'predicted'""")
def discounted_confidence(spark, sf_dir):
    c = cases(spark, sf_dir)
    return lb.discounted(c.where("status = 'predicted'"), lb.false_positive_rates(c)).select("session_id", "seq", "failure", "adjusted")


@query("case_status", f"""WITH {CASES}, a AS (SELECT session_id, failure, arg_max(status, seq) AS verdict FROM cs WHERE status <> 'predicted' GROUP BY ALL)
SELECT session_id, failure, coalesce(verdict, 'predicted') AS status, count(*) AS cases FROM cs LEFT JOIN a USING (session_id, failure) GROUP BY ALL""")
def case_status(spark, sf_dir):
    """The newest verdict on a failure of a session, applied to all its cases."""
    c = cases(spark, sf_dir)
    verdict = c.where("status <> 'predicted'").groupBy("session_id", "failure").agg(F.max_by("status", "seq").alias("verdict"))
    counted = c.groupBy("session_id", "failure").agg(F.count("*").alias("cases"))
    return counted.join(verdict, ["session_id", "failure"], "left").select(
        "session_id", "failure", F.coalesce("verdict", F.lit("predicted")).alias("status"), "cases")


@query("draft_labels", f"""WITH {CASES} SELECT session_id, arg_max(failure, (confidence, -seq)) AS failure, CAST(arg_max(CASE severity WHEN 'critical' THEN 5 ELSE 3 END, (confidence, -seq)) AS INT) AS severity,
  CAST(greatest(1, least(5, floor(max(confidence) * 5))) AS INT) AS confidence, arg_max(step, (confidence, -seq)) AS onset_step FROM cs GROUP BY session_id""")
def draft_labels(spark, sf_dir):
    """A label draft from the most confident diagnosis of each session."""
    best = F.struct(F.col("confidence"), -F.col("seq"))
    severity = F.when(F.col("severity") == "critical", 5).otherwise(3)
    return cases(spark, sf_dir).groupBy("session_id").agg(
        F.max_by("failure", best).alias("failure"), F.max_by(severity, best).alias("severity"),
        F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.max("confidence") * 5))).cast("int").alias("confidence"),
        F.max_by("step", best).alias("onset_step"))


SIZES = b1() + ", sz AS (SELECT session_id, count(*) AS events, session_id % 4 AS project, session_id % 3 AS bucket FROM b1 GROUP BY session_id)"


def sizes(spark, sf_dir):
    return bind.raw_events(spark, sf_dir).groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("events")).withColumns(
        {"project": F.col("session_id") % 4, "bucket": F.col("session_id") % 3})


@query("splits_by_size", f"""WITH {SIZES}, r AS (SELECT session_id, events, row_number() OVER (ORDER BY events DESC, session_id) AS rank FROM sz)
SELECT *, CASE WHEN rank <= 5 THEN 'dev' WHEN rank <= 20 THEN 'val' ELSE 'test' END AS split FROM r""")
def splits_by_size(spark, sf_dir):
    return lb.size_splits(sizes(spark, sf_dir), "session_id", "events", 5, 15)


@query("splits_proportional", f"""WITH {SIZES}, r AS (SELECT session_id, row_number() OVER (ORDER BY session_id) AS rank, count(*) OVER () AS n FROM sz)
SELECT session_id, rank, CASE WHEN rank <= floor(n * 0.2) THEN 'dev' WHEN rank <= floor(n * 0.2) + floor(n * 0.3) THEN 'val' ELSE 'test' END AS split FROM r""")
def splits_proportional(spark, sf_dir):
    return lb.proportional_splits(sizes(spark, sf_dir), "session_id", (("dev", 0.2), ("val", 0.3), ("test", 0.5)))


@query("stratified_folds", f"""WITH {SIZES} SELECT session_id, project, (row_number() OVER (PARTITION BY project ORDER BY sha256('7|' || session_id), session_id) - 1) % 5 AS fold FROM sz""")
def stratified_folds(spark, sf_dir):
    return lb.stratified_folds(sizes(spark, sf_dir), "session_id", "project", 5, 7)


@query("hash_splits", f"""WITH {SIZES}, h AS (SELECT session_id, CAST('0x' || left(sha256(CAST(session_id AS VARCHAR)), 8) AS BIGINT) % 100 AS bucket FROM sz)
SELECT session_id, bucket, CASE WHEN bucket < 10 THEN 'debug' WHEN bucket < 30 THEN 'val' ELSE 'test' END AS split FROM h""")
def hash_splits(spark, sf_dir):
    return sizes(spark, sf_dir).select("session_id", tx.hash_bucket(F.col("session_id")).alias("bucket"),
                                       tx.hash_split(F.col("session_id")).alias("split"))


@query("split_summary", f"""WITH {SIZES}, h AS (SELECT session_id, project, CAST('0x' || left(sha256(CAST(session_id AS VARCHAR)), 8) AS BIGINT) % 100 AS bucket FROM sz),
s AS (SELECT *, CASE WHEN bucket < 10 THEN 'debug' WHEN bucket < 30 THEN 'val' ELSE 'test' END AS split FROM h)
SELECT project, split, count(*) AS sessions FROM s GROUP BY ROLLUP (project, split)""")
def split_summary(spark, sf_dir):
    rows = sizes(spark, sf_dir).select("project", tx.hash_split(F.col("session_id")).alias("split"))
    return rows.rollup("project", "split").agg(F.count("*").alias("sessions"))


@query("split_leakage", f"""WITH {SIZES}, h AS (SELECT session_id, CAST('0x' || left(sha256(CAST(session_id AS VARCHAR)), 8) AS BIGINT) % 100 AS bucket, project FROM sz),
u AS (SELECT session_id, CASE WHEN bucket < 10 THEN 'debug' WHEN bucket < 30 THEN 'val' ELSE 'test' END AS split,
  (['tuning', 'test', 'report', 'test'])[project + 1] AS intended_use FROM h)
SELECT *, (intended_use = 'test' AND split IN ('debug', 'val')) OR (intended_use = 'tuning' AND split = 'test') AS is_leak FROM u""")
def split_leakage(spark, sf_dir):
    uses = F.array(*[F.lit(u) for u in ("tuning", "test", "report", "test")])
    rows = sizes(spark, sf_dir).select("session_id", tx.hash_split(F.col("session_id")).alias("split"),
                                       F.element_at(uses, (F.col("project") + 1).cast("int")).alias("intended_use"))
    leak = ((F.col("intended_use") == "test") & F.col("split").isin("debug", "val")) | (
        (F.col("intended_use") == "tuning") & (F.col("split") == "test"))
    return rows.withColumn("is_leak", leak)


@query("diverse_selection", f"""WITH {SIZES}, r AS (SELECT *, row_number() OVER (PARTITION BY bucket, project ORDER BY events DESC, session_id) AS rk FROM sz),
p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY rk, project, session_id) AS pick FROM r)
SELECT session_id, bucket, project, events, CAST(pick AS INT) AS pick FROM p WHERE pick <= 8""")
def diverse_selection(spark, sf_dir):
    return lb.diverse_selection(sizes(spark, sf_dir), "session_id", "bucket", "project", "events", 8)


SEL = b1() + """, tj AS (SELECT session_id, session_id % 2 = 0 AS target, 'm' || (session_id % 3) AS model, count(*) AS events FROM b1 GROUP BY session_id),
ky AS (SELECT *, left(sha256('20260515|' || session_id || '|' || model), 16) AS sel_key FROM tj)"""


def keyed(spark, sf_dir, key):
    rows = sizes(spark, sf_dir).select("session_id", (F.col("session_id") % 2 == 0).alias("target"), F.concat(
        F.lit("m"), (F.col("session_id") % 3).cast("string")).alias("model"), "events")
    return rows.withColumn("sel_key", key(F.col("session_id"), F.col("model")))


@query("balanced_sample", f"""WITH {SEL} SELECT session_id, target, sel_key FROM ky QUALIFY row_number() OVER (PARTITION BY target ORDER BY sel_key, session_id) <= 40""")
def balanced_sample(spark, sf_dir):
    """The 40 smallest keys of each class; Spark prunes to 40 per class before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy("target").orderBy("sel_key", "session_id")
    rows = keyed(spark, sf_dir, tx.selection_key_sha).withColumn("_r", F.row_number().over(w)).where("_r <= 40")
    return rows.select("session_id", "target", "sel_key")


@query("balanced_sample_keyed")
def balanced_sample_keyed(spark, sf_dir):
    from pyspark.sql import Window
    w = Window.partitionBy("target").orderBy("sel_key", "session_id")
    rows = keyed(spark, sf_dir, tx.selection_key).withColumn("_r", F.row_number().over(w)).where("_r <= 40")
    return rows.select("session_id", "target", "sel_key")


@query("truth_records", f"""WITH {b1()}, t AS (SELECT session_id, count(*) AS n, max(k) AS top FROM b1 GROUP BY session_id),
f AS (SELECT *, session_id % 3 <> 0 AS bad, session_id % 3 = 1 AS detailed FROM t)
SELECT session_id, 'human' AS annotator_type, 'manual' AS annotator_id, 'human_reviewed' AS label_status, bad AS has_failure, '' AS code, 0 AS onset_step, 0 AS severity,
  5 AS confidence, 'Clean trace. Completed=' || CASE WHEN n % 2 = 0 THEN 'True' ELSE 'False' END AS rationale FROM f WHERE NOT bad
UNION ALL SELECT session_id, 'human', 'manual', 'human_reviewed', true, c, CASE WHEN c = '4.2' THEN CAST(top AS INT) ELSE 0 END, CASE WHEN c = '4.2' THEN 4 ELSE 3 END, 3,
  CASE WHEN c = '4.2' THEN 'seen' ELSE '' END FROM f, (VALUES ('4.2'), ('2.1')) v(c) WHERE detailed
UNION ALL SELECT session_id, 'human', 'manual', 'human_reviewed', true, CASE nm WHEN 'context_loss' THEN '2.1' ELSE '' END, 0, 3, 3, 'From ground truth actual_failures: ' || nm
  FROM f, (VALUES ('context_loss'), ('something_else')) v(nm) WHERE bad AND NOT detailed""")
def truth_records(spark, sf_dir):
    per = bind.raw_events(spark, sf_dir).groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("n"), F.max("k").alias("top"))
    bad, detailed = F.col("session_id") % 3 != 0, F.col("session_id") % 3 == 1
    def detail(code, onset, severity, rationale):
        return F.struct(F.lit(code).alias("code"), onset.cast("int").alias("onset_step"), severity.cast("int").alias("severity"),
                        F.lit(None).cast("int").alias("confidence"), rationale.cast("string").alias("rationale"))
    none = F.lit(None)
    traces = per.select("session_id", (F.col("n") % 2 == 0).alias("completed"), F.when(bad, F.array(F.lit("context_loss"), F.lit("something_else"))).alias("failures"),
                        F.when(detailed, F.array(detail("4.2", F.col("top"), F.lit(4), F.lit("seen")), detail("2.1", none, none, none))).alias("details"))
    return lb.truth_records(traces, failure_types(spark))
