"""Detections scored against truth, planted failures, marks and threshold sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from trajlens.operators import agreement as ag
from trajlens.operators import evaluation as ev
from trajlens.plans.baselines import MET, METRICS, SIG, measured, numbered, signed
from trajlens.plans.detectors import ISLAND
from trajlens.plans.registry import query
from trajlens.plans.sqltext import b1
from trajlens.sources import bind

DET = f"""{b1()}, {ISLAND('b1', 'success', 'step', 'f')}, {ISLAND('b1', 'symbol', 'step', 'r')},
det AS (SELECT session_id, 'error_cascade' AS failure, round(len / 10.0, 4) AS confidence, run_end AS step FROM f_runs WHERE NOT val AND len >= 2
  UNION ALL SELECT session_id, 'step_repetition', round(len / 8.0, 4), run_end FROM r_runs WHERE len >= 3),
tru AS (SELECT DISTINCT session_id, 'error_cascade' AS failure, 0 AS onset_step, session_id % 12 = 0 AS is_latent FROM b1 WHERE session_id % 4 = 0
  UNION ALL SELECT DISTINCT session_id, 'step_repetition', 30, false FROM b1 WHERE session_id % 3 = 0),
best AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY session_id, failure ORDER BY confidence DESC, step) = 1),
mt AS (SELECT session_id, failure, confidence, step, onset_step, CASE WHEN onset_step IS NULL THEN 'fp' WHEN step IS NULL THEN 'fn'
    WHEN onset_step = 0 OR abs(step - onset_step) <= 5 THEN 'full' ELSE 'partial' END AS match_type FROM best FULL JOIN
    (SELECT * FROM tru WHERE NOT is_latent) USING (session_id, failure)),
mw AS (SELECT *, CASE match_type WHEN 'full' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END::DOUBLE AS tp_weight FROM mt)"""


def found(spark, sf_dir):
    e = bind.events(spark, sf_dir)
    bad = e.select("success").islands("success").df.where(~F.col("success"))
    same = e.select("symbol").islands("symbol").df
    def runs(df, least, scale, name):
        return df.groupBy("session_id", "run_id").agg(F.count("*").alias("n"), F.max("step").alias("step")).where(
            F.col("n") >= least).select("session_id", F.lit(name).alias("failure"), F.round(F.col("n") / scale, 4).alias("confidence"), "step")
    return runs(bad, 2, 10.0, "error_cascade").unionByName(runs(same, 3, 8.0, "step_repetition"))


def truth(spark, sf_dir):
    ids = bind.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id")).distinct()
    a = ids.where("session_id % 4 = 0").select("session_id", F.lit("error_cascade").alias("failure"), F.lit(0).alias("onset_step"),
                                               (F.col("session_id") % 12 == 0).alias("is_latent"))
    b = ids.where("session_id % 3 = 0").select("session_id", F.lit("step_repetition").alias("failure"), F.lit(30).alias("onset_step"),
                                               F.lit(False).alias("is_latent"))
    return a.unionByName(b)


@query("dedup_detections", f"WITH {DET} SELECT session_id, failure, confidence, step FROM best")
def dedup_detections(spark, sf_dir):
    return ev.strongest(found(spark, sf_dir), ["session_id", "failure"])


@query("match_detections", f"WITH {DET} SELECT * FROM mw")
def match_detections(spark, sf_dir):
    return ev.match(found(spark, sf_dir), truth(spark, sf_dir))


PER = """, per AS (SELECT {k} failure, sum(tp_weight) AS tp, count(*) FILTER (WHERE match_type = 'fp') AS fp, count(*) FILTER (WHERE match_type = 'fn') AS fn,
  count(*) FILTER (WHERE match_type <> 'fn') AS candidates FROM {m} GROUP BY ALL),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN fp = 0 THEN 1.0 ELSE 0.0 END AS r FROM per),
ps AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pr)"""


@query("detector_scores", f"""WITH {DET}{PER.format(k='', m='mw')} SELECT failure, tp, fp, fn, candidates,
  round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1 FROM ps""")
def detector_scores(spark, sf_dir):
    return ev.detector_scores(ev.match(found(spark, sf_dir), truth(spark, sf_dir)))


SUMMARY = """, mac AS (SELECT {k} avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(tp) / nullif(sum(tp) + sum(fp), 0) AS up, sum(tp) / nullif(sum(tp) + sum(fn), 0) AS ur FROM ps {g}),
se AS (SELECT {k} session_id, bool_or(match_type <> 'fn') AS d, bool_or(match_type <> 'fp') AS t, count(*) FILTER (WHERE match_type <> 'fn') AS c FROM {m} GROUP BY ALL),
sl AS (SELECT {k} count(*) FILTER (WHERE d AND t) / nullif(count(*) FILTER (WHERE d), 0) AS sp, count(*) FILTER (WHERE d AND t) / nullif(count(*) FILTER (WHERE t), 0) AS sr,
  count(*) AS n, sum(c) / count(*) AS cps FROM se {g})
SELECT {k} round(mp, 4) AS macro_p, round(mr, 4) AS macro_r, round(mf, 4) AS macro_f1, round(up, 4) AS micro_p, round(ur, 4) AS micro_r,
  round(2 * up * ur / (up + ur), 4) AS micro_f1, round(sp, 4) AS session_p, round(sr, 4) AS session_r, round(2 * sp * sr / (sp + sr), 4) AS session_f1,
  n AS sessions, round(cps, 4) AS candidates_per_session FROM mac {j}"""


@query("summary_scores", f"WITH {DET}{PER.format(k='', m='mw')}{SUMMARY.format(k='', g='', m='mw', j=', sl')}")
def summary_scores(spark, sf_dir):
    return ev.summary_scores(ev.match(found(spark, sf_dir), truth(spark, sf_dir)))


MODES = DET + """, dm AS (SELECT 'strict' AS mode, * FROM det WHERE confidence >= 0.4 UNION ALL SELECT 'loose', * FROM det
  UNION ALL SELECT 'oracle', * FROM det WHERE (session_id, failure) IN (SELECT (session_id, failure) FROM tru)
  UNION ALL SELECT 'suppressed', * FROM det WHERE NOT (failure = 'step_repetition' AND session_id IN (SELECT session_id FROM det WHERE failure = 'error_cascade'))),
bm AS (SELECT * FROM dm QUALIFY row_number() OVER (PARTITION BY mode, session_id, failure ORDER BY confidence DESC, step) = 1),
tm AS (SELECT mode, tru.* FROM tru, (SELECT DISTINCT mode FROM dm) WHERE NOT is_latent),
mm AS (SELECT mode, session_id, failure, CASE WHEN onset_step IS NULL THEN 'fp' WHEN step IS NULL THEN 'fn'
    WHEN onset_step = 0 OR abs(step - onset_step) <= 5 THEN 'full' ELSE 'partial' END AS match_type FROM bm FULL JOIN tm USING (mode, session_id, failure)),
mv AS (SELECT *, CASE match_type WHEN 'full' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END::DOUBLE AS tp_weight FROM mm)"""


def by_mode(spark, sf_dir):
    d, t = found(spark, sf_dir), truth(spark, sf_dir)
    modes = {"strict": d.where("confidence >= 0.4"), "loose": d,
             "oracle": d.join(t.select("session_id", "failure").distinct(), ["session_id", "failure"], "left_semi"),
             "suppressed": ev.without_symptoms(d, "step_repetition", ("error_cascade",))}
    out = None
    for name, part in modes.items():
        part = part.select(F.lit(name).alias("mode"), "session_id", "failure", "confidence", "step")
        out = part if out is None else out.unionByName(part)
    return ev.match(out, t, keys=("mode",))


@query("mode_scores", f"WITH {MODES}{PER.format(k='mode,', m='mv')}{SUMMARY.format(k='mode,', g='GROUP BY mode', m='mv', j='JOIN sl USING (mode)')}")
def mode_scores(spark, sf_dir):
    return ev.summary_scores(by_mode(spark, sf_dir), ("mode",))


@query("detector_winners", f"""WITH {MODES}{PER.format(k='mode,', m='mv')} SELECT failure, mode AS best_mode, round(f, 4) AS f1 FROM ps
QUALIFY row_number() OVER (PARTITION BY failure ORDER BY round(f, 4) DESC, mode) = 1""")
def detector_winners(spark, sf_dir):
    from trajlens.operators.stats import first_by
    scores = ev.detector_scores(by_mode(spark, sf_dir), ("mode",)).select("failure", F.col("mode").alias("best_mode"), "f1")
    return first_by(scores, ["failure"], [-F.col("f1"), F.col("best_mode")])


@query("mcnemar_modes", f"""WITH {MODES}, tk AS (SELECT DISTINCT session_id, failure FROM tru WHERE NOT is_latent),
w AS (SELECT tk.*, bool_or(mode = 'strict' AND tp_weight > 0) AS a, bool_or(mode = 'suppressed' AND tp_weight > 0) AS b FROM tk JOIN mv USING (session_id, failure) GROUP BY ALL),
c AS (SELECT count(*) FILTER (WHERE NOT a AND b) AS b01, count(*) FILTER (WHERE a AND NOT b) AS b10 FROM w),
s AS (SELECT *, CASE WHEN b01 + b10 > 0 THEN (abs(b01 - b10) - 1) ** 2 / (b01 + b10) ELSE 0.0 END AS st FROM c),
x AS (SELECT *, sqrt(st) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * (sqrt(st) / sqrt(2.0))) AS t FROM s)
SELECT b01, b10, round(st, 4) AS statistic, round(p, 4) AS p_value, p < 0.05 AS significant FROM (SELECT *, CASE WHEN b01 + b10 > 0 THEN least(1.0,
  2 * 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)) ELSE 1.0 END AS p FROM x)""")
def mcnemar_modes(spark, sf_dir):
    m = by_mode(spark, sf_dir).where("match_type <> 'fp'")
    def right(mode):
        return F.coalesce(F.bool_or((F.col("mode") == mode) & (F.col("tp_weight") > 0)), F.lit(False))
    flags = m.groupBy("session_id", "failure").agg(right("strict").alias("a"), right("suppressed").alias("b"))
    return ag.mcnemar(flags, [], F.col("a"), F.col("b"))


@query("stored_verdicts", f"""WITH {DET}, v AS (SELECT DISTINCT session_id, (['confirmed', 'rejected', 'uncertain'])[session_id % 3 + 1] AS verdict, 0.5 AS vc FROM b1)
SELECT session_id, failure, CAST(CASE WHEN confidence >= 0.4 THEN confidence WHEN verdict = 'confirmed' THEN greatest(confidence, vc) ELSE vc END AS DOUBLE) AS confidence, step,
  confidence >= 0.4 OR verdict = 'confirmed' AS confirmed FROM det JOIN v USING (session_id) WHERE confidence >= 0.4 OR verdict <> 'rejected'""")
def stored_verdicts(spark, sf_dir):
    d = found(spark, sf_dir)
    words = F.array(*[F.lit(w) for w in ("confirmed", "rejected", "uncertain")])
    verdicts = d.select("session_id", "failure").distinct().select(
        "session_id", "failure", F.element_at(words, (F.col("session_id") % 3 + 1).cast("int")).alias("verdict"),
        F.lit(0.5).alias("verdict_confidence"))
    return ev.confirmed_only(d, verdicts, 0.4)


@query("session_sets", f"""WITH {DET}, d AS (SELECT DISTINCT session_id FROM det), t AS (SELECT DISTINCT session_id FROM tru WHERE NOT is_latent)
SELECT CASE WHEN t.session_id IS NULL THEN 'fp' WHEN d.session_id IS NULL THEN 'fn' ELSE 'tp' END AS kind, count(*) AS sessions FROM d FULL JOIN t USING (session_id) GROUP BY 1""")
def session_sets(spark, sf_dir):
    d = found(spark, sf_dir).select("session_id").distinct().withColumn("d", F.lit(1))
    t = truth(spark, sf_dir).where(~F.col("is_latent")).select("session_id").distinct().withColumn("t", F.lit(1))
    kind = F.when(F.col("t").isNull(), "fp").when(F.col("d").isNull(), "fn").otherwise("tp")
    return d.join(t, "session_id", "full_outer").groupBy(kind.alias("kind")).agg(F.count("*").alias("sessions"))


MAN = SIG + """, man AS (SELECT DISTINCT session_id, (['loop', 'drift', 'thrash'])[session_id % 3 + 1] AS variant, (['web', 'cli'])[session_id % 2 + 1] AS domain,
  150 + session_id * 5 AS inject_step, 180 + session_id * 5 AS inject_end, (['mechanical_repetition', 'distributional_shift', 'unclassified_anomaly'])[session_id % 3 + 1] AS expected FROM b1),
hit AS (SELECT session_id, variant, domain, inject_step, min(step) FILTER (WHERE step BETWEEN inject_step AND inject_end + 30) AS detection_step,
   arg_min(signature, step) FILTER (WHERE step BETWEEN inject_step AND inject_end + 30) AS signature,
   coalesce(bool_or(step BETWEEN inject_step AND inject_end + 30 AND signature = expected), false) AS correct
  FROM man LEFT JOIN sig USING (session_id) GROUP BY ALL)"""


def manifest(spark, sf_dir):
    s = F.col("session_id")
    def pick(*names):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (s % len(names) + 1).cast("int"))
    ids = bind.table(spark, sf_dir, "events").select((F.col("user_id") % 15).alias("session_id")).distinct()
    return ids.select("session_id", pick("loop", "drift", "thrash").alias("variant"), pick("web", "cli").alias("domain"),
                      (150 + s * 5).alias("inject_step"), (180 + s * 5).alias("inject_end"),
                      pick("mechanical_repetition", "distributional_shift", "unclassified_anomaly").alias("expected"))


@query("injection_hits", f"{MAN} SELECT * FROM hit")
def injection_hits(spark, sf_dir):
    return ev.injection_hits(signed(spark, sf_dir), manifest(spark, sf_dir))


@query("hit_rates", f"""{MAN}, g AS (SELECT *, unnest([{{'l': 'overall', 'n': 'all'}}, {{'l': 'variant', 'n': variant}}, {{'l': 'domain', 'n': domain}}]) AS g, detection_step - inject_step AS lat FROM hit)
SELECT g.l AS level, g.n AS name, count(*) AS total, count(lat) AS detected, round(count(lat) / count(*), 4) AS tpr,
  round(count(*) FILTER (WHERE correct) / greatest(count(lat), 1), 4) AS signature_accuracy, round(coalesce(avg(lat), 0.0), 4) AS latency_mean,
  round(coalesce(median(lat), 0.0), 4) AS latency_median, round(coalesce(stddev_samp(lat), 0.0), 4) AS latency_std FROM g GROUP BY 1, 2""")
def hit_rates(spark, sf_dir):
    return ev.hit_rates(ev.injection_hits(signed(spark, sf_dir), manifest(spark, sf_dir)))


@query("variant_matrix", f"""{MAN} SELECT domain, max(CASE WHEN variant = 'loop' THEN detected END) AS loop, max(CASE WHEN variant = 'drift' THEN detected END) AS drift,
  max(CASE WHEN variant = 'thrash' THEN detected END) AS thrash FROM (SELECT domain, variant, count(detection_step) AS detected FROM hit GROUP BY ALL) GROUP BY domain""")
def variant_matrix(spark, sf_dir):
    hits = ev.injection_hits(signed(spark, sf_dir), manifest(spark, sf_dir))
    return hits.groupBy("domain").pivot("variant", ["loop", "drift", "thrash"]).agg(F.count("detection_step"))


MARKS = SIG + """, mk AS (SELECT session_id, step AS mark_step, CASE WHEN event_type = 'error' THEN 'struggling' ELSE 'fine' END AS label FROM b1 WHERE event_id % 20 = 0),
pm AS (SELECT session_id, mark_step, label, count(s.step) AS nearby FROM mk LEFT JOIN (SELECT * FROM sig WHERE signature <> 'unclassified_anomaly') s
   USING (session_id) WHERE true GROUP BY ALL)"""
MARKS = MARKS.replace("USING (session_id) WHERE true", "ON s.session_id = mk.session_id AND abs(s.step - mark_step) <= 15").replace(
    "pm AS (SELECT session_id,", "pm AS (SELECT mk.session_id,")


def per_mark(spark, sf_dir):
    steps = numbered(spark, sf_dir, "event_id", "event_type")
    marks = steps.df.where("event_id % 20 = 0").select(
        "session_id", F.col("step").alias("mark_step"), F.when(F.col("event_type") == "error", "struggling").otherwise("fine").alias("label"))
    return ev.mark_agreement(marks, signed(spark, sf_dir, steps).where("signature <> 'unclassified_anomaly'"))


@query("mark_agreement", f"{MARKS} SELECT * FROM pm")
def mark_agreement(spark, sf_dir):
    return per_mark(spark, sf_dir)


@query("mark_confusion", f"""{MARKS}, c AS (SELECT count(*) FILTER (WHERE label = 'struggling' AND nearby > 0) AS tp, count(*) FILTER (WHERE label = 'fine' AND nearby > 0) AS fp,
  count(*) FILTER (WHERE label = 'struggling' AND nearby = 0) AS fn, count(*) FILTER (WHERE label = 'fine' AND nearby = 0) AS tn, count(*) AS n FROM pm),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
SELECT tp, fp, fn, tn, round((tp + tn) / n, 3) AS agreement_rate, round(p, 3) AS precision, round(r, 3) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 3) AS f1 FROM q""")
def mark_confusion(spark, sf_dir):
    return ev.mark_confusion(per_mark(spark, sf_dir))


ZS = [1.5 + 0.25 * i for i in range(15)]
SWEEP = MET + ", za AS (" + " UNION ALL ".join(
    f"SELECT session_id, step, '{m}' AS metric, CASE WHEN std_{m} < 1e-10 THEN CASE WHEN abs({m} - mean_{m}) > 1e-6 THEN 9.0 END ELSE abs({m} - mean_{m}) / std_{m} END AS z FROM met JOIN st USING (session_id) WHERE step > 100"
    for m in METRICS) + f"""), zt AS (SELECT unnest({ZS}) AS thr),
sw AS (SELECT session_id, step, thr, count(*) AS n FROM za, zt WHERE z > thr GROUP BY ALL HAVING count(*) >= 2),
mn AS (SELECT DISTINCT session_id, session_id % 2 = 1 AS planted, 150 AS lo, 300 AS hi FROM b1),
ln AS (SELECT session_id, count(*) AS len FROM b1 GROUP BY session_id),
pt AS (SELECT thr, count(DISTINCT CASE WHEN planted AND step BETWEEN lo AND hi THEN sw.session_id END) AS hits, count(CASE WHEN NOT planted THEN 1 END) AS alarms
   FROM zt LEFT JOIN sw USING (thr) LEFT JOIN mn USING (session_id) GROUP BY thr),
cu AS (SELECT thr AS z, hits / (SELECT count(*) FROM mn WHERE planted) AS tpr, alarms / (SELECT sum(len) FROM ln JOIN mn USING (session_id) WHERE NOT planted) AS fpr FROM pt)"""


def sweep(spark, sf_dir):
    """(z, tpr, fpr) over the thresholds; the metrics are measured once for all of them.

    A step fires at every threshold below its second largest z-score, so one number
    per step stands for the whole sweep.
    """
    m = measured(spark, sf_dir)
    first = F.col("step") <= 100
    stats = {}
    for name in METRICS:
        v = F.when(first, F.col(name))
        stats[f"_m_{name}"], stats[f"_s_{name}"] = F.avg(v), F.stddev_samp(v)
    based = m.totals(upto=100, **stats)
    zs = []
    for name in METRICS:
        gap, std = F.abs(F.col(name) - F.col(f"_m_{name}")), F.col(f"_s_{name}")
        zs.append(F.coalesce(F.when(std < 1e-10, F.when(gap > 1e-6, F.lit(9.0))).otherwise(gap / std), F.lit(0.0)))
    second = F.element_at(F.sort_array(F.array(*zs), asc=False), 2)
    planted = F.col("session_id") % 2 == 1
    # Each step falls into the widest threshold it passes; cumulative counts give the rest.
    # The second score is bound to a variable, or it would be worked out anew for each threshold.
    passed = F.transform(F.array(second), lambda s: reduce(lambda a, b: a + b, [(s > z).cast("int") for z in ZS]))[0]
    steps = based.df.select("session_id", "step", planted.alias("planted"),
                            F.when(F.col("step") > 100, passed).otherwise(0).alias("level"))
    inside = F.col("planted") & F.col("step").between(150, 300)
    per = steps.groupBy("session_id", "planted").agg(
        F.max(F.when(inside, F.col("level"))).alias("best"), F.count("*").alias("len"),
        *[F.count(F.when(F.col("level") > i, 1)).alias(f"a{i}") for i in range(len(ZS))])
    n_planted, clean_steps = F.count(F.when(F.col("planted"), 1)), F.sum(F.when(~F.col("planted"), F.col("len")))
    curve = per.agg(*[c for i in range(len(ZS)) for c in (
        (F.count(F.when(F.col("best") > i, 1)) / n_planted).alias(f"t{i}"),
        (F.sum(F.when(~F.col("planted"), F.col(f"a{i}")).otherwise(0)) / clean_steps).alias(f"f{i}"))])
    return curve.select(F.inline(F.array(*[
        F.struct(F.lit(z).alias("z"), F.col(f"t{i}").alias("tpr"), F.col(f"f{i}").alias("fpr")) for i, z in enumerate(ZS)])))


@query("threshold_sweep", f"{SWEEP} SELECT CAST(z AS DOUBLE) AS z, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM cu")
def threshold_sweep(spark, sf_dir):
    return sweep(spark, sf_dir).select("z", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("sweep_auc", f"""{SWEEP}, p AS (SELECT DISTINCT fpr, tpr FROM cu), e AS (SELECT * FROM p UNION ALL SELECT 0.0, 0.0 WHERE (SELECT min(fpr) FROM p) > 0
  UNION ALL SELECT 1.0, 1.0 WHERE (SELECT max(fpr) FROM p) < 1),
a AS (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM e WINDOW w AS (ORDER BY fpr, tpr))
SELECT 'all' AS variant, round(sum(a), 4) AS auc FROM a""")
def sweep_auc(spark, sf_dir):
    return ev.sweep_auc(sweep(spark, sf_dir).withColumn("variant", F.lit("all")), ["variant"])


@query("best_threshold", f"""{SWEEP} SELECT 'all' AS variant, CAST(z AS DOUBLE) AS best_z, round(tpr - fpr, 4) AS best_j, round(tpr, 4) AS best_tpr, round(fpr, 4) AS best_fpr
FROM cu ORDER BY round(tpr - fpr, 12) DESC, z LIMIT 1""")
def best_threshold(spark, sf_dir):
    return ev.best_thresholds(sweep(spark, sf_dir).withColumn("variant", F.lit("all")), ["variant"])


@query("lead_lag", f"""{SIG}, {ISLAND('b1', 'symbol', 'step', 'r')}, q AS (SELECT *, row_number() OVER (PARTITION BY session_id, run_id ORDER BY step) AS nth FROM r),
l AS (SELECT session_id, min(step) AS loop_step FROM q WHERE nth = 4 GROUP BY 1), a AS (SELECT session_id, min(step) AS anomaly_step FROM sig GROUP BY 1)
SELECT session_id, loop_step, anomaly_step, loop_step - anomaly_step AS lead, CASE WHEN loop_step IS NULL THEN 'no loop' WHEN anomaly_step IS NULL THEN 'missed'
  WHEN anomaly_step < loop_step THEN 'leads' WHEN anomaly_step = loop_step THEN 'co-fires' ELSE 'lags' END AS verdict FROM l FULL JOIN a USING (session_id)""")
def lead_lag(spark, sf_dir):
    """First anomaly against the first literal loop of each session."""
    steps = numbered(spark, sf_dir)
    runs = steps.islands("symbol")
    loop = runs.df.where(F.col("step") - F.col("run_start") + 1 == 4).groupBy("session_id").agg(F.min("step").alias("loop_step"))
    first = signed(spark, sf_dir, steps).groupBy("session_id").agg(F.min("step").alias("anomaly_step"))
    a, b = F.col("anomaly_step"), F.col("loop_step")
    verdict = (F.when(b.isNull(), "no loop").when(a.isNull(), "missed").when(a < b, "leads").when(a == b, "co-fires").otherwise("lags"))
    return loop.join(first, "session_id", "full_outer").select("session_id", "loop_step", "anomaly_step", (b - a).alias("lead"), verdict.alias("verdict"))


SCENARIOS = DET + """, dd AS (SELECT DISTINCT session_id, failure FROM det), ee AS (SELECT DISTINCT session_id, failure FROM tru),
sj AS (SELECT coalesce(dd.session_id, ee.session_id) AS session_id, dd.failure IS NOT NULL AS d, ee.failure IS NOT NULL AS e FROM dd FULL JOIN ee ON dd.session_id = ee.session_id AND dd.failure = ee.failure),
sc AS (SELECT session_id, count(*) FILTER (WHERE d AND e) AS tp, count(*) FILTER (WHERE d AND NOT e) AS fp, count(*) FILTER (WHERE e AND NOT d) AS fn FROM sj GROUP BY session_id),
sp AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM sc)"""


@query("scenario_scores", f"""WITH {SCENARIOS} SELECT session_id, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1, fp = 0 AND fn = 0 AS exact FROM sp""")
def scenario_scores(spark, sf_dir):
    return ev.scenario_scores(found(spark, sf_dir), truth(spark, sf_dir))


SURE = DET + """, mt2 AS (SELECT session_id, failure, CASE WHEN onset_step IS NULL THEN 'fp' WHEN step IS NULL THEN 'fn'
    WHEN onset_step = 0 OR abs(step - onset_step) <= 5 THEN 'full' ELSE 'partial' END AS match_type FROM (SELECT * FROM best WHERE confidence >= 0.3) FULL JOIN
    (SELECT * FROM tru WHERE NOT is_latent) USING (session_id, failure)),
mw2 AS (SELECT *, CASE match_type WHEN 'full' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END::DOUBLE AS tp_weight FROM mt2)"""


@query("scores_by_split", f"""WITH {SURE}, h AS (SELECT *, CAST('0x' || left(sha256(CAST(session_id AS VARCHAR)), 8) AS BIGINT) % 100 AS bucket FROM mw2),
s AS (SELECT *, CASE WHEN bucket < 10 THEN 'debug' WHEN bucket < 30 THEN 'val' ELSE 'test' END AS split FROM h),
per AS (SELECT split, failure, sum(tp_weight) AS tp, count(*) FILTER (WHERE match_type = 'fp') AS fp, count(*) FILTER (WHERE match_type = 'fn') AS fn, count(*) FILTER (WHERE match_type <> 'fn') AS candidates FROM s GROUP BY ALL),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN fp = 0 THEN 1.0 ELSE 0.0 END AS r FROM per)
SELECT split, failure, tp, fp, fn, candidates, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1 FROM pr""")
def scores_by_split(spark, sf_dir):
    """Detector scores per data split; weak detections are left out before matching."""
    from trajlens.functions.text import hash_split
    m = ev.match(found(spark, sf_dir).where("confidence >= 0.3"), truth(spark, sf_dir))
    return ev.detector_scores(m.withColumn("split", hash_split(F.col("session_id"))), ("split",))
