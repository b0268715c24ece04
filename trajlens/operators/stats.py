"""Statistics as grouped DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.sequence import chunk_limit, longest_group, number_rows


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
              chunk_rows: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    Groups up to ``chunk_rows`` use the built-in aggregate, which keeps a group's
    distinct values in memory. Larger ones are ranked by a range sort and the one
    or two order statistics each quantile needs are picked by rank.
    """
    df = df.where(F.col(value).isNotNull()).select(*keys, value)
    grouped = list(keys)
    if not grouped:
        df, grouped = df.withColumn("_all", F.lit(1)), ["_all"]
    chunk_rows = chunk_limit(df, chunk_rows)
    longest, _ = longest_group(df, grouped)
    if longest <= chunk_rows:
        out = df.groupBy(*grouped).agg(F.count("*").alias("n"), *[
            F.percentile(value, F.lit(p)).alias(name) for name, p in probs.items()])
    else:
        sized = df.groupBy(*grouped, value).agg(F.count("*").alias("_copies"))
        ranked = number_rows(sized, grouped, [value], out="_pos", chunk_rows=chunk_rows)
        upto = ranked.running(_last=("sum", F.col("_copies"))).df
        total = sized.groupBy(*grouped).agg(F.sum("_copies").alias("n"))
        joined = upto.join(total, grouped)
        aggs = []
        for name, p in probs.items():
            at = (F.col("n") - 1) * p
            for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
                holds = (F.col("_last") > rank) & (F.col("_last") - F.col("_copies") <= rank)
                aggs.append(F.max(F.when(holds, F.col(value))).alias(f"_{side}_{name}"))
        picked = joined.groupBy(*grouped, "n").agg(*aggs)
        out = picked.select(*grouped, "n", *[
            (F.col(f"_lo_{name}") + ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p))
             * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name)
            for name, p in probs.items()])
    return out.drop("_all") if not keys else out


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank of each row's value within its group, ties sharing the mean rank.

    Ranks come from the table of distinct values and their counts, so a value that
    many rows share is one row of the ranking.
    """
    grouped = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*grouped, value).agg(F.count("*").alias("_copies"))
    base = counted if grouped else counted.withColumn("_all", F.lit(1))
    by = grouped or ["_all"]
    upto = number_rows(base, by, [value], out="_pos").running(_last=("sum", F.col("_copies"))).result()
    ranks = upto.select(*grouped, value, "_copies",
                        (F.col("_last") - (F.col("_copies") - 1) / 2.0).alias(out))
    return df.join(ranks, [*grouped, value])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``, picked by aggregation and not by a sort.

    ``min_by`` over the ordering struct combines on the map side, so a key with a
    large part of all rows stays cheap. Sort directions are expressed by negating.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal by the 7.1.26 rational approximation of erfc."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z < 0, 1 - tail).otherwise(tail)
