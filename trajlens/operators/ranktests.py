"""Rank tests with their p-values, and all pairs of groups from one table of counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.operators.stats import average_ranks, normal_tail
from trajlens.sequence import number_rows

#: Pairs up to which a signed-rank test without ties takes the exact distribution, and pairs it needs at all.
EXACT_PAIRS, LEAST_PAIRS = 50, 6


def chi_square_tail(value: Column, freedom: Column) -> Column:
    """Upper tail of the chi-square distribution, by the finite sums for whole degrees of freedom."""
    x = F.greatest(value, F.lit(0.0)) / 2
    half = (freedom % 2).cast("double") / 2
    # Terms x^j / gamma(j + 1) for j = 0, 1, ... or for j = 1/2, 3/2, ...
    count = F.floor(freedom / 2).cast("int")
    first = F.when(half == 0, F.lit(1.0)).otherwise(2 * F.sqrt(x / math.pi))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), F.struct(F.lit(0.0).alias("sum"), first.alias("term"), F.lit(0).alias("at")),
                        lambda acc, j: F.struct((acc["sum"] + F.when(j <= count, acc["term"]).otherwise(0.0)).alias("sum"),
                                                (acc["term"] * x / (j + half)).alias("term"), j.alias("at")), lambda acc: acc["sum"])
    rest = F.when(half == 0, F.lit(0.0)).otherwise(2 * normal_tail(F.sqrt(2 * x)))
    return F.least(F.exp(-x) * total + rest, F.lit(1.0))


def signed_rank_tail(n: Column, w: Column) -> Column:
    """P(W >= w) of the sum of the positive ranks of ``n`` untied differences, from the number of sets of ranks with each sum."""
    size = (n * (n + 1) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), size), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, lambda acc, k: F.transform(
        acc, lambda v, i: v + F.when(i >= k, F.get(acc, (i - k).cast("int"))).otherwise(0.0)))
    above = F.aggregate(F.slice(counts, F.ceil(w).cast("int") + 1, size + 1), F.lit(0.0), lambda a, v: a + v)
    return above / F.pow(F.lit(2.0), n)


def wilcoxon(df: DataFrame, first: str, second: str, keys: list[str] | None = None) -> DataFrame:
    """``n_pairs, n_used, w_plus, p_value, significant``: whether ``first`` is greater than ``second`` within pairs.

    Pairs without a difference are left out of the ranks. The p-value is exact up
    to EXACT_PAIRS pairs without ties and zeros, else that of the normal law with
    ties taken off the variance. Fewer than LEAST_PAIRS pairs have none; where no pair
    differs it is 1.
    """
    keys = list(keys or [])
    base = df if keys else df.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    pairs = base.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*by, (F.col(first) - F.col(second)).cast("double").alias("_d"))
    total = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"))
    ranked = average_ranks(pairs.where("_d <> 0").withColumn("_size", F.abs("_d")), by, "_size", "_r")
    ties = ranked.groupBy(*by, "_size").agg(F.count("*").cast("double").alias("_t"), F.sum(F.when(F.col("_d") > 0, F.col("_r"))).alias("_w")).groupBy(*by).agg(
        F.sum("_t").cast("long").alias("n_used"), F.coalesce(F.sum("_w"), F.lit(0.0)).alias("w_plus"), F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    out = total.join(ties, by, "left").withColumns({"n_used": F.coalesce("n_used", F.lit(0)), "w_plus": F.coalesce("w_plus", F.lit(0.0)), "_ties": F.coalesce("_ties", F.lit(0.0))})
    n, w = F.col("n_used").cast("double"), F.col("w_plus")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24)
    exact = (F.col("n_pairs") <= EXACT_PAIRS) & (F.col("_ties") == 0) & (F.col("n_used") == F.col("n_pairs"))
    p = F.when(F.col("n_pairs") < LEAST_PAIRS, F.lit(None).cast("double")).when(F.col("n_used") == 0, F.lit(1.0)).when(
        exact, signed_rank_tail(F.col("n_used"), w)).otherwise(normal_tail((w - n * (n + 1) / 4) / spread))
    return out.select(*keys, "n_pairs", "n_used", "w_plus", F.round(p, 5).alias("p_value"), F.coalesce(p < 0.05, F.lit(False)).alias("significant"))


def kruskal(df: DataFrame, group: str, value: str, least_rows: int = 2) -> DataFrame:
    """``n_groups, h, p_value, significant`` over groups of at least ``least_rows`` values; fewer than two such groups give none."""
    sized = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    kept = sized.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_rows).select(group)
    ranked = average_ranks(sized.join(kept, group).withColumn("_one", F.lit(1)), ["_one"], value, "_r")
    sums = ranked.groupBy("_one", group).agg(F.sum("_r").alias("_s"), F.count("*").cast("double").alias("_c")).groupBy("_one").agg(
        F.count("*").alias("n_groups"), F.sum(F.col("_s") * F.col("_s") / F.col("_c")).alias("_q"), F.sum("_c").alias("_n"))
    ties = ranked.groupBy("_one", value).agg(F.count("*").cast("double").alias("_t")).groupBy("_one").agg(F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    n = F.col("_n")
    h = (12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / (1 - F.col("_ties") / (n * n * n - n))
    p = chi_square_tail(h, F.col("n_groups") - 1)
    tested = (F.col("n_groups") >= 2) & (F.col("_ties") < n * n * n - n)
    return sums.join(ties, "_one").select("n_groups", F.when(tested, F.round(h, 6)).alias("h"), F.when(tested, F.round(p, 5)).alias("p_value"),
                                          F.coalesce(tested & (p < 0.05), F.lit(False)).alias("significant"))


def pairwise_mann_whitney(df: DataFrame, group: str, value: str, least_rows: int = 2) -> DataFrame:
    """``group_a, group_b, u, p_raw, p_adjusted, significant`` for every two groups, two-sided, with Bonferroni over all of them.

    Counts per value and group are all that is needed: a value's row meets what
    other groups have at and below it, as running counts per group, so groups of any size
    cost their distinct values. The normal law is taken, with ties and half a rank of continuity.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").cast("double").alias("_n"))
    sizes = counts.groupBy(group).agg(F.sum("_n").alias("_size")).where(F.col("_size") >= least_rows)
    counts = counts.join(sizes.select(group), group, "left_semi")
    values = counts.select(value).distinct()
    # Every group at every value of any, so that each knows what it has below: one row of the grid carries the groups.
    groups = sizes.agg(F.collect_list(group).alias("_groups")).withColumn("_one", F.lit(1))
    grid = values.withColumn("_one", F.lit(1)).join(F.broadcast(groups), "_one").select(value, F.explode("_groups").alias(group))
    full = grid.join(counts, [group, value], "left").withColumn("_n", F.coalesce("_n", F.lit(0.0)))
    below = number_rows(full, [group], [value], "_at").running(exclusive=True, _below=("sum", F.col("_n"))).result()
    a = below.select(value, F.col(group).alias("group_a"), F.col("_n").alias("_na"))
    b = below.select(value, F.col(group).alias("group_b"), F.col("_n").alias("_nb"), F.coalesce("_below", F.lit(0.0)).alias("_below"))
    met = a.join(b, value).where(F.col("group_a") < F.col("group_b"))
    both = F.col("_na") + F.col("_nb")
    per = met.groupBy("group_a", "group_b").agg(F.sum(F.col("_na") * (F.col("_below") + F.col("_nb") / 2)).alias("u"), F.sum("_na").alias("_n1"), F.sum("_nb").alias("_n2"),
                                                F.sum(F.pow(both, F.lit(3)) - both).alias("_ties"))
    n1, n2 = F.col("_n1"), F.col("_n2")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    raw = F.when(spread > 0, F.least(2 * normal_tail(F.greatest(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, F.lit(0.0)) / spread), F.lit(1.0))).otherwise(1.0)
    many = sizes.agg(F.count("*").alias("_g"), F.lit(1).alias("_one"))
    out = per.withColumn("_one", F.lit(1)).join(many, "_one")
    adjusted = F.least(raw * F.col("_g") * (F.col("_g") - 1) / 2, F.lit(1.0))
    return out.select("group_a", "group_b", "u", F.round(raw, 5).alias("p_raw"), F.round(adjusted, 5).alias("p_adjusted"), (adjusted < 0.05).alias("significant"))
