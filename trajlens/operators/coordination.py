"""Coordination between agents that share resources in one interleaved stream.

Input: an ordered global stream with ``agent_id, resource, is_read, is_write``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.sequence import Ordered, number_rows

WINDOW = 20


def _recent(ev: Ordered, what: str, window: int) -> Ordered:
    """Per row, the other agents that did ``what`` to its resource in the last ``window`` steps.

    Only events of the same resource at most ``window`` steps back are looked at, so
    the collected list never holds more than ``window`` entries.
    """
    entry = F.when(F.col(what), F.struct(F.col("agent_id").alias("agent"), F.col(ev.order).alias("step")))
    return ev.frame(window, 0, {"_recent": (
        ("resource",), lambda w: F.collect_list(entry).over(w.rangeBetween(-window, -1)))})


def _latest_per_agent(rows: DataFrame, keys: list[str], order: str, by: str) -> DataFrame:
    """One row per event and other agent with that agent's latest step."""
    return rows.select(*keys, F.col(order).alias("step"), F.col("agent_id").alias(by), "resource",
                       F.explode("_recent").alias("_o")).where(F.col("_o.agent") != F.col(by)).groupBy(
        *keys, "step", by, "resource", F.col("_o.agent").alias("other_agent")).agg(F.max("_o.step").alias("other_step"))


def write_read_signals(ev: Ordered, window: int = WINDOW) -> DataFrame:
    """Reads of a resource that another agent wrote shortly before."""
    reads = _recent(ev, "is_write", window).df.where("is_read")
    found = _latest_per_agent(reads, list(ev.keys), ev.order, "reader")
    return found.select(F.col("other_agent").alias("source_agent"), F.col("reader").alias("target_agent"), "resource",
                        F.col("other_step").alias("source_step"), F.col("step").alias("target_step"),
                        (F.col("step") - F.col("other_step")).alias("latency_steps"))


def write_conflicts(ev: Ordered, window: int = WINDOW) -> DataFrame:
    """Writes shortly after another agent's write (race) or read (concurrent modification)."""
    parts = []
    for what, failure in (("is_write", "race_condition"), ("is_read", "concurrent_modification")):
        writes = _recent(ev, what, window).df.where("is_write")
        found = _latest_per_agent(writes, list(ev.keys), ev.order, "writer")
        parts.append(found.select(
            F.lit(failure).alias("failure_type"), F.col("writer").alias("agent"), "other_agent", "resource", "step",
            (F.col("step") - F.col("other_step")).alias("gap")))
    return parts[0].unionByName(parts[1])


def stale_reads(ev: Ordered, window: int = WINDOW) -> DataFrame:
    """Writes to a resource another agent last read more than ``window`` steps ago.

    Every write is put to each agent that ever read the resource; the latest read
    before it is a running last value over that agent's reads and those probes,
    in chunks where one (resource, agent) stream is long.
    """
    keys = list(ev.keys)
    reads = ev.df.where("is_read").select(*keys, "resource", F.col("agent_id").alias("other_agent"),
                                          F.col(ev.order).alias("step"), F.lit(None).cast(
                                              ev.df.schema["agent_id"].dataType).alias("writer"))
    readers = reads.groupBy(*keys, "resource", "other_agent").agg(F.min("step").alias("_first"))
    probes = ev.df.where("is_write").select(*keys, "resource", F.col("agent_id").alias("writer"),
                                            F.col(ev.order).alias("step")).join(readers, [*keys, "resource"]).where(
        (F.col("writer") != F.col("other_agent")) & (F.col("_first") < F.col("step"))).drop("_first")
    both = number_rows(reads.unionByName(probes), [*keys, "resource", "other_agent"], ["step", "writer"], "_pos", ev.chunk_rows)
    seen = both.running(_read=("last", F.when(F.col("writer").isNull(), F.col("step"))))
    gap = F.col("step") - F.col("_read")
    return seen.df.where(F.col("writer").isNotNull() & (gap > window)).select(
        F.lit("stale_read").alias("failure_type"), F.col("other_agent").alias("agent"),
        F.col("writer").alias("other_agent"), "resource", "step", gap.alias("gap"))


def strength(count: Column) -> Column:
    return F.when(count >= 5, "strong").when(count >= 2, "moderate").otherwise("weak")


def dependencies(signals: DataFrame) -> DataFrame:
    counted = signals.groupBy(F.col("source_agent").alias("producer"), F.col("target_agent").alias("consumer")).agg(
        F.count("*").alias("signal_count"))
    return counted.withColumn("strength", strength(F.col("signal_count")))


def pair_status(failures: DataFrame) -> DataFrame:
    """Failures per unordered agent pair and the status they give the pair."""
    a, b = F.least("agent", "other_agent"), F.greatest("agent", "other_agent")
    per = failures.groupBy(a.alias("agent_a"), b.alias("agent_b")).agg(
        *[F.count(F.when(F.col("failure_type") == t, 1)).alias(t)
          for t in ("race_condition", "concurrent_modification", "stale_read")])
    return per.withColumn("status", F.when(F.col("race_condition") + F.col("stale_read") > 0, "warning").otherwise("normal"))


def agent_activity(ev: Ordered) -> DataFrame:
    return ev.df.groupBy("agent_id").agg(
        F.count("*").alias("events"), F.count_distinct(F.when(F.col("is_read"), F.col("resource"))).alias("resources_read"),
        F.count_distinct(F.when(F.col("is_write"), F.col("resource"))).alias("resources_written"),
        F.max(F.when(F.col("is_read"), F.col(ev.order))).alias("last_read"),
        F.max(F.when(F.col("is_write"), F.col(ev.order))).alias("last_write"))
