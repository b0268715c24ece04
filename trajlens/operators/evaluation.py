"""Scoring detections against ground truth.

Detections: ``mode?, session_id, failure, confidence, step``. Truth: ``session_id,
failure, onset_step, is_latent``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.operators.stats import first_by, quantiles


def prf(tp: Column, fp: Column, fn: Column, empty: str = "agree") -> tuple[Column, Column, Column]:
    """Precision, recall, F1. With nothing detected, precision is 1 if nothing was missed
    (``agree``), always 1 (``one``) or 0 (``zero``); recall likewise."""
    nothing = {"agree": lambda other: F.when(other == 0, 1.0).otherwise(0.0), "one": lambda other: F.lit(1.0),
               "zero": lambda other: F.lit(0.0)}[empty]
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(nothing(fn))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(nothing(fp))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def strongest(detections: DataFrame, keys: list[str]) -> DataFrame:
    """The most confident detection per session and failure, the earliest among equals."""
    return first_by(detections, keys, [-F.col("confidence"), F.col("step")])


def match(detections: DataFrame, truth: DataFrame, window: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one matches of the strongest detections with observable truth.

    Both sides hold one row per session and failure, so greedy matching is a plain
    join: full within the step window (or with no onset given), else partial.
    """
    on = [*keys, "session_id", "failure"]
    best = strongest(detections, on).select(*on, "confidence", "step")
    seen = truth.where(~F.col("is_latent")).groupBy("session_id", "failure").agg(F.min("onset_step").alias("onset_step"))
    if keys:
        seen = _spread(detections, seen, keys)
    joined = best.join(seen, on, "full_outer")
    near = (F.col("onset_step") == 0) | (F.abs(F.col("step") - F.col("onset_step")) <= window)
    kind = (F.when(F.col("onset_step").isNull(), "fp").when(F.col("step").isNull(), "fn")
            .when(near, "full").otherwise("partial"))
    weight = F.when(kind == "full", 1.0).when(kind == "partial", 0.5).otherwise(0.0)
    return joined.select(*on, "confidence", "step", "onset_step", kind.alias("match_type"), weight.alias("tp_weight"))


def _spread(detections: DataFrame, truth: DataFrame, keys: tuple[str, ...], parts: int = 16) -> DataFrame:
    """Truth repeated for each evaluation mode present; both sides meet in ``parts`` parts, so neither is collected."""
    modes = detections.select(*keys).distinct().withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return truth.withColumn("_part", F.pmod(F.xxhash64("session_id"), F.lit(parts)).cast("int")).join(modes, "_part").drop("_part")


def detector_scores(matches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    per = matches.groupBy(*keys, "failure").agg(
        F.sum("tp_weight").alias("tp"), F.count(F.when(F.col("match_type") == "fp", 1)).alias("fp"),
        F.count(F.when(F.col("match_type") == "fn", 1)).alias("fn"),
        F.count(F.when(F.col("match_type") != "fn", 1)).alias("candidates"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return per.select(*keys, "failure", "tp", "fp", "fn", "candidates", F.round(p, 4).alias("precision"),
                      F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


def summary_scores(matches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Macro, micro and session-level scores."""
    per = matches.groupBy(*keys, "failure").agg(
        F.sum("tp_weight").alias("tp"), F.count(F.when(F.col("match_type") == "fp", 1)).alias("fp"),
        F.count(F.when(F.col("match_type") == "fn", 1)).alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    mp, mr, mf = prf(F.sum("tp"), F.sum("fp"), F.sum("fn"), "zero")
    macro = per.groupBy(*keys).agg(
        F.round(F.avg(p), 4).alias("macro_p"), F.round(F.avg(r), 4).alias("macro_r"), F.round(F.avg(f), 4).alias("macro_f1"),
        F.round(mp, 4).alias("micro_p"), F.round(mr, 4).alias("micro_r"), F.round(mf, 4).alias("micro_f1"),
        F.lit(1).alias("_one"))
    sessions = matches.groupBy(*keys, "session_id").agg(
        F.bool_or(F.col("match_type") != "fn").alias("d"), F.bool_or(F.col("match_type") != "fp").alias("t"),
        F.count(F.when(F.col("match_type") != "fn", 1)).alias("c"))
    sp, sr, sf = prf(F.count(F.when(F.col("d") & F.col("t"), 1)), F.count(F.when(F.col("d") & ~F.col("t"), 1)),
                     F.count(F.when(~F.col("d") & F.col("t"), 1)), "zero")
    level = sessions.groupBy(*keys).agg(
        F.round(sp, 4).alias("session_p"), F.round(sr, 4).alias("session_r"), F.round(sf, 4).alias("session_f1"),
        F.count("*").alias("sessions"), F.round(F.sum("c") / F.count("*"), 4).alias("candidates_per_session"),
        F.lit(1).alias("_one"))
    return macro.join(level, [*keys, "_one"]).drop("_one")


def without_symptoms(detections: DataFrame, symptom: str, causes: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Drops the symptom in sessions where a cause fired."""
    caused = detections.where(F.col("failure").isin(*causes)).select(*keys, "session_id").distinct()
    return detections.where(F.col("failure") != symptom).unionByName(
        detections.where(F.col("failure") == symptom).join(caused, [*keys, "session_id"], "left_anti"))


def confirmed_only(detections: DataFrame, verdicts: DataFrame, sure: float = 0.9) -> DataFrame:
    """Applies stored verdicts: confirmed raises confidence, rejected drops, uncertain replaces it.

    Detections at ``sure`` confidence or above stand without a verdict.
    """
    joined = detections.join(verdicts, ["session_id", "failure"], "left")
    automatic = F.col("confidence") >= sure
    kept = joined.where(automatic | F.col("verdict").isNull() | (F.col("verdict") != "rejected"))
    conf = (F.when(automatic | F.col("verdict").isNull(), F.col("confidence"))
            .when(F.col("verdict") == "confirmed", F.greatest("confidence", "verdict_confidence"))
            .otherwise(F.col("verdict_confidence")))
    return kept.select("session_id", "failure", conf.alias("confidence"), "step",
                       (automatic | (F.col("verdict") == "confirmed")).alias("confirmed"))


def injection_hits(found: DataFrame, manifest: DataFrame, window: int = 30) -> DataFrame:
    """First detection of each planted failure within its range plus ``window`` steps."""
    joined = manifest.join(found, "session_id", "left")
    inside = F.col("step").between(F.col("inject_step"), F.col("inject_end") + window)
    return joined.groupBy("session_id", "variant", "domain", "inject_step").agg(
        F.min(F.when(inside, F.col("step"))).alias("detection_step"),
        F.min_by("signature", F.when(inside, F.struct("step", "signature"))).alias("signature"),
        F.coalesce(F.bool_or(inside & (F.col("signature") == F.col("expected"))), F.lit(False)).alias("correct"))


def hit_rates(hits: DataFrame) -> DataFrame:
    """True-positive rate, signature accuracy and latency overall, by variant and by domain."""
    latency = F.col("detection_step") - F.col("inject_step")
    rows = hits.select(F.explode(F.array(
        F.struct(F.lit("overall").alias("level"), F.lit("all").alias("name")),
        F.struct(F.lit("variant").alias("level"), F.col("variant").alias("name")),
        F.struct(F.lit("domain").alias("level"), F.col("domain").alias("name")))).alias("g"),
        latency.alias("latency"), "correct")
    detected = F.count("latency")
    rows = rows.select("g.level", "g.name", "latency", "correct")
    # Exact, and not in one task's memory: the level "overall" holds every row.
    median = quantiles(rows, ["level", "name"], "latency", {"_median": 0.5}).drop("n")
    per = rows.groupBy("level", "name").agg(
        F.count("*").alias("total"), detected.alias("detected"), F.round(detected / F.count("*"), 4).alias("tpr"),
        F.round(F.count(F.when(F.col("correct"), 1)) / F.greatest(detected, F.lit(1)), 4).alias("signature_accuracy"),
        F.round(F.coalesce(F.avg("latency"), F.lit(0.0)), 4).alias("latency_mean"),
        F.round(F.coalesce(F.stddev_samp("latency"), F.lit(0.0)), 4).alias("latency_std"))
    return per.join(median, ["level", "name"], "left").withColumn(
        "latency_median", F.round(F.coalesce("_median", F.lit(0.0)), 4)).drop("_median")


def mark_agreement(marks: DataFrame, named: DataFrame, window: int = 15) -> DataFrame:
    """Each human mark with the number of named detections within ``window`` steps.

    Steps are bucketed by the window width: a mark meets the detections of its own
    and the two neighbouring buckets only, so a session with very many of both is
    spread over its buckets. Detections are counted per step before the join.
    """
    width = window + 1
    per_step = named.groupBy("session_id", "step").agg(F.count("*").alias("_n"))
    bucketed = per_step.select("session_id", "step", "_n", F.expr(f"step div {width}").alias("_b"))
    probes = marks.select("*", F.explode(F.array(*[F.expr(f"mark_step div {width}") + i for i in (-1, 0, 1)])).alias("_b"))
    joined = probes.join(bucketed, ["session_id", "_b"], "left")
    near = F.abs(F.col("step") - F.col("mark_step")) <= window
    return joined.groupBy("session_id", "mark_step", "label").agg(
        F.coalesce(F.sum(F.when(near, F.col("_n"))), F.lit(0)).alias("nearby"))


def mark_confusion(per_mark: DataFrame) -> DataFrame:
    hit, bad = F.col("nearby") > 0, F.col("label") == "struggling"
    counts = per_mark.agg(
        F.count(F.when(bad & hit, 1)).alias("tp"), F.count(F.when(~bad & hit, 1)).alias("fp"),
        F.count(F.when(bad & ~hit, 1)).alias("fn"), F.count(F.when(~bad & ~hit, 1)).alias("tn"), F.count("*").alias("marks"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"), "zero")
    return counts.select("tp", "fp", "fn", "tn", F.round((F.col("tp") + F.col("tn")) / F.col("marks"), 3).alias("agreement_rate"),
                         F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f, 3).alias("f1"))


def sweep_auc(points: DataFrame, keys: list[str]) -> DataFrame:
    """Area under (fpr, tpr) points by trapezoids, anchored at (0, 0) and (1, 1).

    The points of one curve are the few thresholds of a sweep.
    """
    ends = points.groupBy(*keys).agg(F.min("fpr").alias("_lo"), F.max("fpr").alias("_hi"))
    anchors = ends.select(*keys, F.explode(F.filter(F.array(
        F.when(F.col("_lo") > 0, F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))),
        F.when(F.col("_hi") < 1, F.struct(F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr")))),
        lambda x: x.isNotNull())).alias("_p")).select(*keys, "_p.fpr", "_p.tpr")
    every = points.select(*keys, "fpr", "tpr").distinct().unionByName(anchors)
    w = Window.partitionBy(*keys).orderBy("fpr", "tpr")
    area = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return every.withColumn("_a", area).groupBy(*keys).agg(F.round(F.sum("_a"), 4).alias("auc"))


def best_thresholds(points: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold with the largest tpr - fpr, the lowest on ties."""
    j = F.col("tpr") - F.col("fpr")
    return points.groupBy(*keys).agg(
        F.max_by(F.struct("z", "tpr", "fpr", j.alias("j")), F.struct(F.round(j, 12), -F.col("z"))).alias("_b")).select(
        *keys, F.col("_b.z").alias("best_z"), F.round("_b.j", 4).alias("best_j"), F.round("_b.tpr", 4).alias("best_tpr"),
        F.round("_b.fpr", 4).alias("best_fpr"))


def scenario_scores(detections: DataFrame, expected: DataFrame) -> DataFrame:
    """Per session the detected against the expected set of failures."""
    d = detections.select("session_id", "failure").distinct().withColumn("_d", F.lit(1))
    e = expected.select("session_id", "failure").distinct().withColumn("_e", F.lit(1))
    per = d.join(e, ["session_id", "failure"], "full_outer").groupBy("session_id").agg(
        F.count(F.when(F.col("_d").isNotNull() & F.col("_e").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("_e").isNull(), 1)).alias("fp"), F.count(F.when(F.col("_d").isNull(), 1)).alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"), "one")
    return per.select("session_id", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
                      F.round(f, 4).alias("f1"), ((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"))
