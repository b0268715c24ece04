"""Task phases: the committed phase of every event, transitions, segments, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.functions.events import PHASES, is_strong, phase_name, phase_of
from trajlens.sequence import Ordered

# Share of the task done on reaching each phase.
PHASE_WEIGHT = {1: 0.20, 2: 0.35, 3: 0.75, 4: 0.95, 5: 1.00}


def phase_machine(ev: Ordered, kind: str = "type", tool: str = "tool") -> Ordered:
    """Adds ``class_rank`` (the event's own phase) and ``phase_rank`` (the committed one).

    A phase commits on the first event, on a strong event, or on the second of two
    adjacent events of the same phase: after any of these the committed phase is
    the event's own, whatever it was before, and no other event can change it. So
    the machine is a one-row look-back and a running last value.
    """
    classed = ev.with_columns(class_rank=phase_of(F.col(kind), F.col(tool)))
    strong = is_strong(F.col(kind), F.col(tool), F.col("class_rank"))
    marked = classed.frame(1, 0, {"_commits": lambda w: (
        (F.col(ev.order) == 1) | strong | (F.lag("class_rank").over(w) == F.col("class_rank")))})
    phased = marked.running(phase_rank=("last", F.when(F.col("_commits"), F.col("class_rank"))))
    moved = phased.frame(1, 0, {"from_rank": lambda w: F.coalesce(F.lag("phase_rank").over(w), F.lit(0))})
    return moved.on(moved.df.withColumns({
        "is_transition": F.col("phase_rank") != F.col("from_rank"),
        "is_regression": F.col("phase_rank") < F.col("from_rank"),
    }).drop("_commits"))


def transitions(phased: Ordered) -> DataFrame:
    return phased.df.where("is_transition").select(
        *phased.keys, F.col(phased.order).alias("at_step"), phase_name(F.col("from_rank")).alias("from_phase"),
        phase_name(F.col("phase_rank")).alias("to_phase"), "is_regression")


def segments(phased: Ordered, phase: str = "phase") -> Ordered:
    """Adds ``segment_id``: the number of the contiguous stretch of one phase."""
    return phased.islands(phase, run="segment_id", start="segment_start")


def segment_stats(segmented: Ordered) -> DataFrame:
    """One row per phase segment; needs type, tool, success, tokens, latency_ms, timestamp.

    The tool distribution of a segment is counted per (segment, tool) first, so a
    segment that holds a large part of the table is still aggregated map-side.
    """
    key = [*segmented.keys, "segment_id", "phase"]
    call = F.col("type") == "tool_call"
    tool = F.when(call, F.coalesce("tool", F.lit("unknown")))
    calls = segmented.with_columns(_tool=tool)
    previous = calls.running(exclusive=True, _prev_tool=("last", F.col("_tool")),
                             _prev_at=("last", F.when(F.col("_tool").isNotNull(), F.col(segmented.order))))
    repeat = (F.col("_prev_tool") == F.col("_tool")) & (F.col("_prev_at") >= F.col("segment_start"))
    per_tool = previous.df.groupBy(*key, "_tool").agg(
        F.count("*").alias("_n"), F.count(F.when(repeat, 1)).alias("_repeats"),
        F.count(F.when(F.col("type").isin("planning", "reasoning"), 1)).alias("_planning"),
        F.count(F.when(~F.col("success"), 1)).alias("_errors"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("_tokens"),
        F.sum(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("_latency"),
        F.count(F.when(F.col("latency_ms") > 0, 1)).alias("_latencies"),
        F.min("timestamp").alias("_from"), F.max("timestamp").alias("_to"))
    named = F.col("_tool").isNotNull()
    c = F.when(named, F.col("_n").cast("double"))
    totals = per_tool.groupBy(*key).agg(
        F.sum("_n").alias("step_count"), F.coalesce(F.sum(F.when(named, F.col("_n"))), F.lit(0)).alias("tool_calls"),
        F.count(F.when(named, 1)).alias("unique_tools"), F.sum("_repeats").alias("_repeats"),
        F.sum("_planning").alias("planning_events"), F.sum("_errors").alias("error_count"),
        F.sum("_tokens").alias("total_tokens"), F.sum("_latency").alias("_latency"),
        F.sum("_latencies").alias("_latencies"), (F.max("_to") - F.min("_from")).alias("_span"),
        F.sum(c * F.log2(c)).alias("_clogc"))
    calls_n = F.greatest("tool_calls", F.lit(1))
    n = F.col("tool_calls").cast("double")
    return totals.select(
        *key, "step_count", "tool_calls", "unique_tools",
        F.round(F.col("unique_tools") / calls_n, 4).alias("tool_diversity"),
        F.round(F.col("_repeats") / calls_n, 4).alias("repetition_rate"), "planning_events", "error_count",
        F.round(F.col("error_count") / F.col("step_count"), 4).alias("error_rate"), "total_tokens",
        F.round(F.coalesce("_latency", F.lit(0.0)) / F.greatest("_latencies", F.lit(1)) + 1e-9, 1).alias("avg_latency_ms"),
        F.round("_span", 2).alias("duration_sec"),
        F.when(n > 0, F.round(F.greatest(F.log2(n) - F.col("_clogc") / n, F.lit(0.0)) + 1e-12, 4))
        .otherwise(0.0).alias("action_entropy"))


def progress(phased: Ordered) -> DataFrame:
    """Per session: final phase, progress percentage, completion rate, regressions, phase counts."""
    counts = {f"{p}_events": F.count(F.when(F.col("class_rank") == i, 1))
              for i, p in enumerate(PHASES) if i}
    per = phased.df.groupBy(*phased.keys).agg(
        F.max_by("phase_rank", phased.order).alias("current_rank"), F.max("phase_rank").alias("max_rank"),
        F.count(F.when(F.col("is_regression"), 1)).alias("regressions"),
        F.count(F.when(F.col("is_transition"), 1)).alias("transitions"),
        F.count("*").alias("total_events"), *[c.alias(n) for n, c in counts.items()])
    rank = F.col("current_rank")
    here = _by_rank(rank, PHASE_WEIGHT)
    below = F.when(rank > 1, _by_rank(rank - 1, PHASE_WEIGHT)).otherwise(0.0)
    in_phase = _by_rank(rank, {i: F.col(f"{p}_events") for i, p in enumerate(PHASES) if i})
    share = F.least(in_phase / 10.0, F.lit(1.0))
    return per.select(
        *phased.keys, phase_name(rank).alias("current_phase"), phase_name(F.col("max_rank")).alias("max_phase"),
        "regressions", "transitions", "total_events", *counts,
        F.round(below + (here - below) * share, 4).alias("progress"))


def _by_rank(rank: Column, table: dict) -> Column:
    chain = F
    for k, v in table.items():
        chain = chain.when(rank == k, v)
    return chain
