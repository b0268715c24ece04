"""Agreement between raters, from counts and never from formed pairs of ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.operators.stats import average_ranks
from trajlens.sequence import number_rows


def _shares(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def cohens_kappa(df: DataFrame, keys: Sequence[str], a: str, b: str, weight: str | None = None,
                 linear: bool = False) -> DataFrame:
    """Kappa of the value pairs (a, b) in each group, unweighted or linearly weighted.

    The linear disagreement expected by chance is summed over the cut points between
    adjacent categories: |i - j| counts the cuts between i and j, so it needs the
    cumulative margins only and no product of categories.
    """
    given = list(keys)
    keys = given or ["_all"]
    if not given:
        df = df.withColumn("_all", F.lit(1))
    n = F.sum(weight) if weight else F.count("*")
    cells = df.groupBy(*keys, a, b).agg(n.alias("_n"))
    margins = cells.select(*keys, F.inline(F.array(
        F.struct(F.col(a).alias("_v"), F.col("_n").alias("_ra"), F.lit(0).cast("long").alias("_rb")),
        F.struct(F.col(b).alias("_v"), F.lit(0).cast("long").alias("_ra"), F.col("_n").alias("_rb"))))
    ).groupBy(*keys, "_v").agg(F.sum("_ra").alias("_ra"), F.sum("_rb").alias("_rb"))
    by = Window.partitionBy(*keys)
    upto = by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = margins.select(
        *keys, "_v", "_ra", "_rb", F.row_number().over(by.orderBy("_v")).alias("_i"),
        F.count("*").over(by).alias("_k"), F.sum("_ra").over(by).alias("_n"),
        F.sum("_ra").over(upto).alias("_ca"), F.sum("_rb").over(upto).alias("_cb"))
    n = F.col("_n").cast("double")
    cut = F.col("_ca") * (n - F.col("_cb")) + F.col("_cb") * (n - F.col("_ca"))
    expected = ranked.groupBy(*keys).agg(
        F.first("_k").alias("_k"), F.first("_n").alias("n"),
        F.sum(cut / (n * n)).alias("_exp_linear"), F.sum(F.col("_ra") / n * F.col("_rb") / n).alias("_exp_same"))
    index = ranked.select(*keys, "_v", "_i")
    observed = (cells.join(index.withColumnsRenamed({"_v": a, "_i": "_ia"}), [*keys, a])
                .join(index.withColumnsRenamed({"_v": b, "_i": "_ib"}), [*keys, b])
                .groupBy(*keys).agg(F.sum(F.abs(F.col("_ia") - F.col("_ib")) * F.col("_n")).alias("_dist"),
                                    F.sum(F.when(F.col("_ia") == F.col("_ib"), F.col("_n")).otherwise(0)).alias("_same")))
    joined = observed.join(expected, keys)
    if linear:
        value = F.when(F.col("_exp_linear") > 0, 1 - F.col("_dist") / F.col("n") / F.col("_exp_linear")).otherwise(1.0)
    else:
        value = F.when(F.col("_exp_same") < 1, (F.col("_same") / F.col("n") - F.col("_exp_same"))
                       / (1 - F.col("_exp_same"))).otherwise(1.0)
    value = F.when(F.col("_k") < 2, 1.0).otherwise(value)
    return joined.select(*given, "n", F.round(F.col("_same") / F.col("n"), 6).alias("agreement"),
                         F.round(value, 6).alias("kappa"))


def krippendorff_alpha(df: DataFrame, keys: Sequence[str], item: str, value: str, ordinal: bool = True) -> DataFrame:
    """Alpha over any number of raters per item.

    All ordered pairs of ratings of an item count alike. With category ranks i and
    N ratings, the squared rank distances sum to 2 (N sum(i^2) - sum(i)^2), and the
    differing pairs to N^2 less the squared category counts.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, item, value).agg(F.count("*").alias("_n"))
    cats = counts.groupBy(*keys, value).agg(F.sum("_n").alias("_total"))
    by = Window.partitionBy(*keys)
    ranked = cats.select(*keys, value, "_total", (F.row_number().over(by.orderBy(value)) - 1).alias("_i"))
    i = F.col("_i").cast("double")

    def pairs(n: str) -> list[Column]:
        c = F.col(n).cast("double")
        return [F.sum(c).alias("_s0"), F.sum(c * i).alias("_s1"), F.sum(c * i * i).alias("_s2"), F.sum(c * c).alias("_sq")]

    def disagreement() -> Column:
        if ordinal:
            return 2 * (F.col("_s0") * F.col("_s2") - F.col("_s1") * F.col("_s1"))
        return F.col("_s0") * F.col("_s0") - F.col("_sq")

    n_pairs = F.col("_s0") * (F.col("_s0") - 1)
    per_item = counts.join(ranked.select(*keys, value, "_i"), [*keys, value]).groupBy(*keys, item).agg(*pairs("_n"))
    observed = per_item.where(F.col("_s0") >= 2).groupBy(*keys).agg(
        (F.sum(disagreement()) / F.sum(n_pairs)).alias("_observed"), F.count("*").alias("items"))
    expected = ranked.groupBy(*keys).agg(*pairs("_total"), F.count("*").alias("_k")).select(
        *keys, (disagreement() / F.greatest(n_pairs, F.lit(1.0))).alias("_expected"), F.col("_s0").cast("long").alias("ratings"))
    out = observed.join(expected, keys)
    alpha = F.when(F.col("_expected") == 0, 1.0).otherwise(1 - F.col("_observed") / F.col("_expected"))
    return out.select(*keys, "items", "ratings", F.round(alpha, 6).alias("alpha"))


def rater_pairs(df: DataFrame, item: Sequence[str], keys: Sequence[str], rater: str, value: str) -> DataFrame:
    """Counts of value pairs for every two raters of the same items.

    Items with the same ratings by the same raters are counted together first, so
    value pairs are formed per distinct rating pattern and not per item. A pattern
    holds one entry per rater of an item.
    """
    patterns = df.groupBy(*item, *[k for k in keys if k not in item]).agg(
        F.array_sort(F.collect_list(F.struct(F.col(rater).alias("r"), F.col(value).alias("v")))).alias("_p"))
    counted = patterns.groupBy(*keys, "_p").agg(F.count("*").alias("_items"))
    one = counted.select(*keys, "_p", "_items", F.posexplode("_p").alias("_at", "_a"))
    rest = one.select(*keys, "_items", "_a", F.explode(F.slice("_p", F.col("_at") + 2, F.size("_p"))).alias("_b"))
    return rest.groupBy(*keys, F.col("_a.r").alias("rater_a"), F.col("_b.r").alias("rater_b"),
                        F.col("_a.v").alias("value_a"), F.col("_b.v").alias("value_b")).agg(F.sum("_items").alias("n"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, ident: str, ordinal: bool = False) -> DataFrame:
    """Rank correlation per group, by average ranks or by ordinal ranks with ties in id order."""
    keys = list(keys)
    base = df if keys else df.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    if ordinal:
        ranked = number_rows(number_rows(base, by, [x, ident], "_rx").result(), by, [y, ident], "_ry").result()
    else:
        ranked = average_ranks(average_ranks(base, by, x, "_rx"), by, y, "_ry")
    n = F.col("n")
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("_corr"),
                                  F.sum((F.col("_rx") - F.col("_ry")) * (F.col("_rx") - F.col("_ry"))).alias("_d2"))
    exact = F.when(n >= 2, 1 - 6 * F.col("_d2") / (n * (n * n - 1).cast("double"))).otherwise(0.0)
    return out.select(*keys, "n", F.round("_corr", 6).alias("rho"), F.round(exact, 6).alias("rho_d2"))


def mcnemar(df: DataFrame, keys: Sequence[str], a: Column, b: Column, two_sided: bool = True) -> DataFrame:
    """McNemar test with continuity correction on two right/wrong flags per case."""
    from trajlens.operators.stats import normal_tail
    per = df.groupBy(*keys).agg(F.count(F.when(~a & b, 1)).alias("b01"), F.count(F.when(a & ~b, 1)).alias("b10"))
    total = F.col("b01") + F.col("b10")
    stat = F.when(total > 0, F.pow(F.abs(F.col("b01") - F.col("b10")) - 1, F.lit(2)) / total).otherwise(0.0)
    tail = normal_tail(F.sqrt(stat)) * (2 if two_sided else 1)
    p = F.when(total > 0, F.least(tail, F.lit(1.0))).otherwise(1.0)
    return per.select(*keys, "b01", "b10", F.round(stat, 4).alias("statistic"), F.round(p, 4).alias("p_value"),
                      (p < 0.05).alias("significant"))
