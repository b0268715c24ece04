"""Rank tests against counting and sums written out."""

import itertools
import math
import random

from pyspark.sql import functions as F

from trajlens.operators import ranktests as rt


def _tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def test_signed_ranks_by_counting_every_sign(spark):
    rnd = random.Random(1)
    for n in (6, 9, 12):
        diffs = rnd.sample(range(1, 60), n)
        diffs = [d if rnd.random() < 0.7 else -d for d in diffs]
        ranks = sorted(range(1, n + 1), key=lambda r: r)
        order = sorted(diffs, key=abs)
        w = sum(r for r, d in zip(ranks, order) if d > 0)
        want = sum(sum(r for r, s in zip(ranks, signs) if s) >= w for signs in itertools.product((0, 1), repeat=n)) / 2 ** n
        got = rt.wilcoxon(spark.createDataFrame([(float(d), 0.0) for d in diffs], "a double, b double"), "a", "b").first()
        assert got.w_plus == w and abs(got.p_value - want) < 6e-6 and got.significant == (want < 0.05)


def test_signed_ranks_of_few_equal_and_tied_pairs(spark):
    table = spark.createDataFrame([("few", 2.0, 1.0)] * 5 + [("same", 1.0, 1.0)] * 8 + [("tied", float(2 + k % 3), 1.0) for k in range(20)] + [("tied", None, 1.0)],
                                  "g string, a double, b double")
    got = {r.g: r for r in rt.wilcoxon(table, "a", "b", ["g"]).collect()}
    assert got["few"].p_value is None and not got["few"].significant
    assert got["same"].p_value == 1.0 and got["same"].n_used == 0
    ties = sum(t ** 3 - t for t in (7, 7, 6))
    z = (210 - 20 * 21 / 4) / math.sqrt((20 * 21 * 41 - ties / 2) / 24)
    assert got["tied"].n_pairs == 20 and abs(got["tied"].p_value - _tail(z)) < 6e-6


def test_chi_square_tails(spark):
    rows = [(x, d) for d in range(1, 12) for x in (0.0, 0.3, 2.5, 9.0, 30.0)]
    got = spark.createDataFrame(rows, "x double, d int").select("x", "d", rt.chi_square_tail(F.col("x"), F.col("d")).alias("p")).collect()
    for r in got:
        a, h = r.d / 2, r.x / 2
        lower = sum(math.exp((a + j) * math.log(h) - h - math.lgamma(a + j + 1)) for j in range(300)) if h else 0.0
        assert abs(r.p - (1 - lower)) < 1e-6


def test_all_pairs_of_groups(spark):
    rnd = random.Random(4)
    groups = {"a": [rnd.randint(0, 5) for _ in range(40)], "b": [rnd.randint(2, 8) for _ in range(25)], "c": [rnd.randint(0, 5) for _ in range(30)], "one": [3]}
    table = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), (None, 1.0)], "g string, v double")
    got = {(r.group_a, r.group_b): r for r in rt.pairwise_mann_whitney(table, "g", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), r in got.items():
        a, b = groups[x], groups[y]
        u = sum((p > q) + (p == q) / 2 for p in a for q in b)
        n, both = len(a) + len(b), a + b
        ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
        z = (abs(u - len(a) * len(b) / 2) - 0.5) / math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
        p = min(2 * _tail(z), 1)
        assert r.u == u and abs(r.p_raw - p) < 6e-6 and abs(r.p_adjusted - min(3 * p, 1)) < 2e-5
    k = rt.kruskal(table, "g", "v").first()
    assert k.n_groups == 3 and k.significant
    assert rt.kruskal(table.where("g = 'a'"), "g", "v").first().p_value is None
    assert rt.pairwise_mann_whitney(table.where("false"), "g", "v").collect() == []
