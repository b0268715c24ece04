"""Fitted phase baselines and self-calibrating anomaly detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.operators.stats import quantiles
from trajlens.sequence import Ordered

PHASE_METRICS = ("step_count", "tool_diversity", "repetition_rate", "action_entropy", "error_rate", "avg_latency_ms")
QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}

# Signatures in order of priority, with severity; conditions in ``signature``.
SEVERITY = {"mechanical_repetition": "warning", "tight_iteration": "info", "distributional_shift": "warning",
            "context_thrashing": "warning", "execution_regression": "warning", "stagnation": "critical",
            "distributional_anomaly": "info", "memory_thrashing": "warning", "unclassified_anomaly": "info"}


def long_metrics(df: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """Wide metric columns as rows (metric, value)."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.inline(cells))


def phase_distributions(segments: DataFrame) -> DataFrame:
    """Count, mean, sample deviation and quantiles of each phase metric over all segments."""
    cells = long_metrics(segments, ["phase"], PHASE_METRICS)
    moments = cells.groupBy("phase", "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    spread = quantiles(cells, ["phase", "metric"], "value", QUANTILES)
    out = moments.join(spread, ["phase", "metric"])
    return out.select("phase", "metric", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", *QUANTILES)])


def score_segments(segments: DataFrame, fitted: DataFrame, min_n: int = 3) -> DataFrame:
    """Segment metrics beyond the 95th percentile of their phase."""
    cells = long_metrics(segments, ["session_id", "segment_id", "phase"], PHASE_METRICS)
    return cells.join(fitted.select("phase", "metric", "n", "p95"), ["phase", "metric"]).select(
        "session_id", "segment_id", "phase", "metric", "value",
        ((F.col("n") >= min_n) & (F.col("value") > F.col("p95"))).alias("is_anomalous"))


def transition_model(moves: DataFrame, rare: float = 0.05) -> DataFrame:
    """P(next phase | phase) with rank and rare transitions; the phase set is small and fixed."""
    counts = moves.groupBy("from_phase", "to_phase").agg(F.count("*").alias("n"))
    totals = counts.groupBy("from_phase").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.join(totals, "from_phase").select(
        "from_phase", "to_phase", "n", F.round(p, 6).alias("probability"), (p < rare).alias("is_rare"))


def share_table(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Share of each item within its key."""
    counts = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(totals, keys).withColumn("share", F.col("n") / F.col("total"))


def tool_divergence(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence of each (session, phase) tool mix from the phase's baseline.

    Tools the session never used still count through the baseline. Their part is the
    baseline mass not covered by the session's tools, halved, so the session side
    needs no rows for them.
    """
    joined = observed.select("session_id", "phase", "tool", F.col("share").alias("p")).join(
        expected.select("phase", "tool", F.col("share").alias("q")), ["phase", "tool"], "left")
    q = F.coalesce("q", F.lit(0.0))
    m = (F.col("p") + q) / 2
    term = F.col("p") * F.log2(F.col("p") / m) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    per = joined.groupBy("session_id", "phase").agg(F.sum(term).alias("_t"), F.sum(q).alias("_q"))
    known = expected.select("phase").distinct()
    return per.join(known, "phase").select(
        "session_id", "phase", F.round(F.greatest((F.col("_t") + (1 - F.col("_q"))) / 2, F.lit(0.0)), 6).alias("divergence"))


def novel_tools(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Tools of a (session, phase) that the phase's baseline never saw."""
    fresh = observed.join(expected.select("phase").distinct(), "phase", "left_semi").join(
        expected.select("phase", "tool"), ["phase", "tool"], "left_anti")
    used = observed.groupBy("session_id", "phase").agg(F.count("*").alias("tools"))
    count = fresh.groupBy("session_id", "phase").agg(F.count("*").alias("novel"))
    return used.join(count, ["session_id", "phase"]).select(
        "session_id", "phase", "tools", "novel", F.round(F.col("novel") / F.col("tools"), 6).alias("novel_ratio"))


def novel_calls(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of the calls of a (session, phase) whose tool the phase's baseline never saw."""
    seen = expected.select("phase", "tool", F.lit(True).alias("_seen"))
    joined = observed.join(expected.select("phase").distinct(), "phase", "left_semi").join(seen, ["phase", "tool"], "left")
    return joined.groupBy("session_id", "phase").agg(
        F.round(F.sum(F.when(F.col("_seen").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("novel_ratio"))


def calibrated(ev: Ordered, metrics: tuple[str, ...], calibration: int = 100, sensitivity: float = 2.0) -> Ordered:
    """Per metric: z-score against the session's first observations, and ``<m>_dir`` when anomalous."""
    first = F.col(ev.order) <= calibration
    aggs = {}
    for m in metrics:
        v = F.when(first & ~F.isnan(m), F.col(m))
        aggs[f"_mean_{m}"], aggs[f"_std_{m}"] = F.avg(v), F.stddev_samp(v)
    based = ev.totals(upto=calibration, **aggs)
    cols = {}
    for m in metrics:
        mean, std, v = F.col(f"_mean_{m}"), F.col(f"_std_{m}"), F.col(m)
        gap = v - mean
        flat = std < 1e-10
        z = F.when(flat, F.when(F.abs(gap) > 1e-6, F.lit(sensitivity + 1))).otherwise(F.abs(gap) / std)
        live = (F.col(ev.order) > calibration) & (z > sensitivity) & std.isNotNull()
        cols[f"{m}_z"] = F.when(live, F.round(z, 2))
        cols[f"{m}_dir"] = F.when(live, F.when(gap > 0, "high").otherwise("low"))
    return based.on(based.df.withColumns(cols))


def anomalies(scored: Ordered, metrics: tuple[str, ...]) -> DataFrame:
    """Anomalous metrics as rows."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"{m}_z").alias("z_score"),
                               F.col(f"{m}_dir").alias("direction")) for m in metrics])
    return scored.df.select(*scored.keys, F.col(scored.order), F.inline(cells)).where(F.col("direction").isNotNull())


def signature(metrics: tuple[str, ...], min_metrics: int = 2) -> Column:
    """Named pattern of the anomalous metrics of a step; null below ``min_metrics`` of them."""
    def has(metric: str, direction: str) -> Column:
        if metric not in metrics:
            return F.lit(False)
        return F.coalesce(F.col(f"{metric}_dir") == direction, F.lit(False))

    n = reduce(lambda a, b: a + b, [F.col(f"{m}_dir").isNotNull().cast("int") for m in metrics])
    low = has("action_entropy", "low") | has("tool_entropy", "low")
    high_kl = has("kl_divergence", "high")
    named = (
        F.when(low & has("action_mi", "low"), "mechanical_repetition")
        .when(low & has("action_mi", "high"), "tight_iteration")
        .when(high_kl & (has("last_surprisal", "high") | has("action_entropy", "high") | has("read_entropy", "high")),
              "distributional_shift")
        .when(high_kl & has("action_mi", "high") & ~has("action_entropy", "high"), "context_thrashing")
        .when(has("compression_ratio", "low") & (has("action_entropy", "low") | has("read_entropy", "low")),
              "execution_regression")
        .when(has("compression_ratio", "low") & has("kl_divergence", "low"), "stagnation")
        .when(high_kl & (has("action_entropy", "low") | has("action_entropy", "high")), "distributional_anomaly")
        .when(has("memory_escalation_rate", "high") & has("namespace_entropy", "high"), "memory_thrashing")
        .otherwise("unclassified_anomaly"))
    return F.when(n >= min_metrics, named)


def gradual_decline(ev: Ordered, metric: str, calibration: int = 100, window: int = 30) -> DataFrame:
    """Steps where the recent slope is clearly negative and the value is low for the session."""
    first = F.col(ev.order) <= calibration
    v = F.when(first, F.col(metric))
    based = ev.totals(upto=calibration, _mean=F.avg(v), _std=F.stddev_samp(v))
    y = F.when(F.col(ev.order) > calibration, F.col(metric))
    x = F.col(ev.order)

    def over(f):
        return lambda w: f.over(w.rowsBetween(1 - window, 0))

    framed = based.frame(window - 1, 0, {
        "_n": over(F.count(y)), "_slope": over(F.regr_slope(y, x)), "_sxx": over(F.regr_sxx(y, x)),
        "_syy": over(F.regr_syy(y, x)), "_sxy": over(F.regr_sxy(y, x))})
    rest = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))
    se = F.sqrt(rest / (window - 2)) / F.sqrt("_sxx")
    limit = F.col("_mean") - 0.84 * F.col("_std")
    return framed.df.where((F.col("_n") == window) & (F.col("_std") >= 1e-10) & (se >= 1e-12)
                           & (F.col("_slope") < -2 * se) & (F.col(metric) < limit)).select(
        *ev.keys, F.col(ev.order), F.round("_slope", 6).alias("slope"), F.round(F.col(metric), 4).alias("current"))


def change_points(ev: Ordered, metrics: tuple[str, ...], width: int = 20, shift: float = 2.5) -> DataFrame:
    """First step where any metric's means in two adjacent windows differ by ``shift`` pooled deviations.

    At least one more observation must follow the second window.
    """
    def over(f, m, lo, hi):
        return lambda w: f(m).over(w.rowsBetween(lo, hi))

    cols: dict = {"_na": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-width, -1)),
                  "_nb": lambda w: F.count(F.lit(1)).over(w.rowsBetween(0, width))}
    hit = F.lit(False)
    for m in metrics:
        cols |= {f"_ma_{m}": over(F.avg, m, -width, -1), f"_mb_{m}": over(F.avg, m, 0, width - 1),
                 f"_va_{m}": over(F.var_pop, m, -width, -1), f"_vb_{m}": over(F.var_pop, m, 0, width - 1)}
        pooled = F.sqrt((F.col(f"_va_{m}") + F.col(f"_vb_{m}")) / 2) + 1e-9
        hit = hit | (F.abs(F.col(f"_mb_{m}") - F.col(f"_ma_{m}")) / pooled >= shift)
    framed = ev.frame(width, width, cols)
    full = (F.col("_na") == width) & (F.col("_nb") == width + 1)
    return framed.df.where(full & hit).groupBy(*ev.keys).agg(F.min(ev.order).alias("first_step"))


def leave_one_out(ev: Ordered, metrics: tuple[str, ...], limit: float = 2.0, agree: int = 2) -> DataFrame:
    """First step at which ``agree`` metrics lie ``limit`` deviations off all other sessions.

    The other sessions' mean and variance are the totals less the session's own sums.
    """
    parts = {f"{n}_{m}": f(c) for m in metrics for n, f, c in (
        ("n", F.count, F.col(m)), ("s", F.sum, F.col(m)), ("q", F.sum, F.col(m) * F.col(m)))}
    every = ev.df.agg(*[c.alias(n) for n, c in parts.items()]).first().asDict()
    own = ev.totals(**parts)
    off = F.lit(0)
    for m in metrics:
        n = F.lit(every[f"n_{m}"]) - F.col(f"n_{m}")
        mean = (F.lit(every[f"s_{m}"]) - F.col(f"s_{m}")) / n
        var = (F.lit(every[f"q_{m}"]) - F.col(f"q_{m}")) / n - mean * mean
        std = F.sqrt(F.greatest(var, F.lit(0.0)))
        off = off + F.coalesce(((std > 1e-9) & (F.abs((F.col(m) - mean) / std) >= limit)).cast("int"), F.lit(0))
    return own.df.where(off >= agree).groupBy(*ev.keys).agg(F.min(ev.order).alias("first_step"))
