"""Models and tests of trajectory features against an outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from trajlens.operators import agreement as ag
from trajlens.operators import evaluation as ev
from trajlens.operators import models as md
from trajlens.operators import study as sd
from trajlens.operators import trajectories as tj
from trajlens.plans.evaluation import DET, found, truth
from trajlens.plans.features import COHERENCE
from trajlens.plans.registry import query
from trajlens.plans.sqltext import b1
from trajlens.session import durable
from trajlens.sources import bind

TOOLS = ["create", "edit", "open", "python", "search_dir"]
AWARE = ["coverage", "explore_ratio", "read_before_first_edit", "blind_edit_rate", "verify_rate"]
COHERENT = ["mean", "min", "final", "slope", "verb_align_rate", "target_match_rate"]
ERRORS = ["episodes", "recurrence_rate", "strategy_change_rate", "recovery_rate", "mean_latency"]


def feature_table(spark, sf_dir):
    """One row per trajectory: tool counts, construct features and the outcome, joined by id.

    Written out once, since the fits read it several times.
    """
    turns = bind.turns(spark, sf_dir)
    acted = tj.actions(turns)
    counts = tj.tool_counts(acted).groupBy("session_id").pivot("tool_name", TOOLS).agg(F.sum("n")).na.fill(0)
    parts = [counts, tj.awareness(acted), tj.error_recovery(turns),
             tj.coherence(turns).withColumnsRenamed({c: f"tac_{c}" for c in COHERENT}), tj.action_symbols_entropy(acted)]
    joined = reduce(lambda a, b: a.join(b, "session_id"), parts)
    return durable(md.with_folds(joined.withColumn("target", (F.col("session_id") % 2 == 0).cast("double")), "session_id"))


@query("ridge_gate")
def ridge_gate(spark, sf_dir):
    """Share of each feature that tool counts alone explain; 0.80 or more fails the gate."""
    names = [*AWARE, "entropy", *[f"tac_{c}" for c in COHERENT]]
    r2 = md.ridge_cv(feature_table(spark, sf_dir), TOOLS, names)
    return spark.createDataFrame([(n, None if v is None else round(v, 6), None if v is None else v < 0.8) for n, v in r2.items()], "feature string, r2 double, passes boolean")


@query("outcome_null_test")
def outcome_null_test(spark, sf_dir):
    return md.null_test(feature_table(spark, sf_dir), "session_id", [*AWARE, "entropy"], "target", 40)


@query("outcome_gain")
def outcome_gain(spark, sf_dir):
    df = feature_table(spark, sf_dir)
    base = md.logistic_cv(df, "session_id", TOOLS, "target")
    full = md.logistic_cv(df, "session_id", [*TOOLS, *[f"tac_{c}" for c in COHERENT]], "target")
    return md.decision(md.bootstrap_auc_gain(base, full, 200), 0.03)


@query("graded_rank_correlation")
def graded_rank_correlation(spark, sf_dir):
    """Rank correlation of out-of-fold ridge predictions with a graded outcome."""
    df = feature_table(spark, sf_dir).withColumn("grade", F.col("recovery_rate"))
    scored = md.ridge_out_of_fold(df, [*AWARE, "entropy"], "grade")
    return ag.spearman(scored.select("session_id", "score", "grade"), [], "score", "grade", "session_id")


@query("bootstrap_means")
def bootstrap_means(spark, sf_dir):
    return md.bootstrap_means(feature_table(spark, sf_dir), "session_id", AWARE, 200)


@query("bootstrap_detector_scores")
def bootstrap_detector_scores(spark, sf_dir):
    return md.bootstrap_detector_scores(ev.match(found(spark, sf_dir), truth(spark, sf_dir)), 200)


@query("detector_cross_validation")
def detector_cross_validation(spark, sf_dir):
    """F1 of each detector per fold of sessions, as mean and spread."""
    m = md.with_folds(ev.match(found(spark, sf_dir), truth(spark, sf_dir)), "session_id")
    per = ev.detector_scores(m, ("fold",))
    return per.groupBy("failure").agg(F.round(F.avg("f1"), 4).alias("mean_f1"), F.round(F.stddev_pop("f1"), 4).alias("std_f1"), F.count("*").alias("folds"))


def _tail(p: str) -> str:
    """P(X >= hits) of binomial(total, p) as a sum."""
    return f"""CASE WHEN hits <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(hits, total + 1), lambda i:
      exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln({p}) + (total - i) * ln(1 - {p}))))) END"""


@query("binomial_hit_test", f"""WITH RECURSIVE {DET},
bc AS (SELECT failure, count(*) FILTER (WHERE tp_weight > 0) AS hits, count(*) AS total FROM mw WHERE match_type <> 'fp' GROUP BY failure),
bi AS (SELECT failure, hits, total, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS it FROM bc UNION ALL
  SELECT failure, hits, total, CASE WHEN t < 0.05 THEN mid ELSE lo END, CASE WHEN t < 0.05 THEN hi ELSE mid END, it + 1
  FROM (SELECT *, {_tail('mid')} AS t FROM (SELECT *, (lo + hi) / 2 AS mid FROM bi WHERE it < 60)))
SELECT failure, hits, total, round({_tail('0.5')}, 6) AS p_value, CASE WHEN hits > 0 THEN round(lo, 6) ELSE 0.0 END AS low FROM bi WHERE it = 60""")
def binomial_hit_test(spark, sf_dir):
    m = ev.match(found(spark, sf_dir), truth(spark, sf_dir)).where("match_type <> 'fp'")
    per = m.groupBy("failure").agg(F.count(F.when(F.col("tp_weight") > 0, 1)).alias("hits"), F.count("*").alias("total"))
    tested = md.binomial_test(per, "hits", "total", 0.5)
    return tested.withColumns({"p_value": F.round("p_value", 6), "low": F.round("low", 6)})


@query("rank_auc", f"""WITH {b1()}, s AS (SELECT session_id, session_id % 3 AS g, session_id % 2 AS y, count(*) FILTER (WHERE NOT success) AS score FROM b1 GROUP BY session_id),
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0 AS rk FROM s)
SELECT g, round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc FROM r GROUP BY g""")
def rank_auc(spark, sf_dir):
    s = bind.raw_events(spark, sf_dir).groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("score"))
    rows = s.select((F.col("user_id") % 3).alias("g"), (F.col("user_id") % 2).alias("y"), "score")
    return md.rank_auc(rows, ["g"]).select("g", F.round("auc", 6).alias("auc"))


PER_TOOL = ", ".join(f"count(*) FILTER (WHERE tool_name = '{t}')::DOUBLE AS t{i}" for i, t in enumerate(TOOLS))


def most(construct: str) -> str:
    """The largest absolute correlation of a construct with any tool's count."""
    return "round(greatest(" + ", ".join(f"abs(corr({construct}, t{i}))" for i in range(len(TOOLS))) + "), 6)"


@query("construct_correlations", f"""WITH {COHERENCE}, f AS (SELECT session_id, round(avg(va), 6) AS verb, round(avg(tm), 6) AS tgt FROM sc GROUP BY session_id),
c AS (SELECT session_id, {PER_TOOL} FROM act GROUP BY session_id)
SELECT unnest(['verb_align_rate', 'target_match_rate']) AS construct, unnest([{most('verb')}, {most('tgt')}]) AS max_abs_r FROM f JOIN c USING (session_id)""")
def construct_correlations(spark, sf_dir):
    turns = bind.turns(spark, sf_dir)
    counts = tj.tool_counts(tj.actions(turns)).groupBy("session_id").pivot("tool_name", TOOLS).agg(F.sum("n").cast("double")).na.fill(0)
    return md.max_correlations(tj.coherence(turns).join(counts, "session_id"), ["verb_align_rate", "target_match_rate"], TOOLS)


CLASSED = f"""WITH {b1()}, c AS (SELECT session_id, session_id % 2 AS y, arg_min(event_type, step) AS opening, arg_max(event_type, step) AS ending, CASE WHEN max(k) % 10 = 0 THEN 'm' || (max(k) % 7) END AS model FROM b1 GROUP BY session_id),
fo AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY sha256(CAST(session_id AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold FROM c)"""


def classed(spark, sf_dir):
    """Sessions with an outcome, three categories and a stratified fold."""
    ev = bind.events(spark, sf_dir)
    top = F.max("k")
    per = ev.df.groupBy("session_id").agg(F.min_by("event_type", "step").alias("opening"), F.max_by("event_type", "step").alias("ending"),
                                          F.when(top % 10 == 0, F.concat(F.lit("m"), (top % 7).cast("string"))).alias("model"),
                                          F.count("*").alias("events"), F.count(F.when(~F.col("success"), 1)).alias("errors"))
    return sd.stratified_folds(per.withColumn("y", F.col("session_id") % 2), "session_id", "y")


@query("stratified_outcome_folds", f"{CLASSED} SELECT session_id, y, fold FROM fo")
def stratified_outcome_folds(spark, sf_dir):
    return classed(spark, sf_dir).select("session_id", "y", "fold")


@query("known_levels", f"""{CLASSED}, l AS (SELECT fold, unnest(['opening', 'ending', 'model']) AS "column", unnest([opening, ending, coalesce(model, 'None')]) AS level FROM fo),
p AS (SELECT "column", level, fold, count(*) AS rows FROM l GROUP BY ALL)
SELECT *, sum(rows) OVER (PARTITION BY "column", level) > rows AS known FROM p""")
def known_levels(spark, sf_dir):
    return sd.known_levels(classed(spark, sf_dir), ["opening", "ending", "model"])


@query("study_decision")
def study_decision(spark, sf_dir):
    """Whether all tools' calls tell the outcome, and add to length, errors and categories."""
    turns = bind.turns(spark, sf_dir)
    tools = sd.counted(tj.actions(turns).df, "session_id", "tool_name", "tool")
    rows = durable(classed(spark, sf_dir).join(tools, "session_id", "left"))
    signal = sd.above_null(sd.named_logistic(rows, "session_id", "y", [], F.col("named"), 19))
    trivial = ["events", "errors"]
    kinds = sd.one_hot("opening", "ending", "model")
    base = sd.named_logistic(rows, "session_id", "y", trivial, kinds)
    full = sd.named_logistic(rows, "session_id", "y", trivial, F.concat(kinds, F.coalesce("named", F.array())))
    return sd.decide(signal, md.bootstrap_auc_gain(base, full, 100))
