"""Ordered operations against brute force, with and without splitting."""

import random

import pytest
from pyspark.sql import functions as F

from trajlens.sequence import number_rows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # Session 0 holds most of the rows.
    return [(0 if rng.random() < 0.7 else rng.randrange(1, 5), i * 3 % 401, i, rng.choice("abc"), rng.randrange(100))
            for i in range(400)]


def expected(rows):
    out = {}
    for s in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2]))
        seen, total = set(), 0
        for n, r in enumerate(ordered, 1):
            seen.add(r[3])
            total += r[4]
            window = ordered[max(0, n - 1 - 9):n]
            ahead = ordered[n - 1:n + 2]
            last_b = next((q[4] for q in reversed(ordered[:n]) if q[3] == "b"), None)
            out[r[2]] = (n, total, len(seen), sum(q[4] for q in window), sum(q[4] for q in ahead), last_b,
                         total - r[4], len(ordered))
    return out


@pytest.mark.parametrize("chunk", [7, 25, 100_000])
def test_ordered_operations(spark, rows, chunk):
    df = spark.createDataFrame(rows, "session_id long, at long, id long, symbol string, v long").repartition(5)
    ev = number_rows(df, ["session_id"], ["at", "id"], chunk_rows=chunk)
    assert ev.split == (chunk < 1000)
    ev = ev.frame(9, 2, {
        "back": lambda w: F.sum("v").over(w.rowsBetween(-9, 0)), "ahead": lambda w: F.sum("v").over(w.rowsBetween(0, 2))})
    ev = ev.running(total=("sum", F.col("v")), last_b=("last", F.when(F.col("symbol") == "b", F.col("v"))))
    ev = ev.running(exclusive=True, before=("sum", F.col("v"))).distinct_so_far("symbol", "known").totals(n=F.max("step"))
    got = {r["id"]: (r["step"], r["total"], r["known"], r["back"], r["ahead"], r["last_b"], r["before"], r["n"])
           for r in ev.df.collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("chunk", [6, 100_000])
def test_islands_and_substream(spark, chunk):
    values = list("aabbbaaaac") * 3
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "session_id long, at long, symbol string")
    ev = number_rows(df, ["session_id"], ["at"], chunk_rows=chunk)
    runs = ev.islands("symbol").df.groupBy("run_id").agg(F.count("*").alias("n"), F.first("symbol").alias("s")).orderBy("run_id").collect()
    assert [(r["s"], r["n"]) for r in runs] == [("a", 2), ("b", 3), ("a", 4), ("c", 1)] * 3
    sub = ev.substream(F.col("symbol") == "a").df.orderBy("sub_step").collect()
    assert [r["sub_step"] for r in sub] == list(range(1, 19))


def test_lists_of_all_earlier_rows_are_refused(spark):
    df = spark.createDataFrame([(1, i) for i in range(20)], "session_id long, at long")
    for chunk in (6, 100):
        with pytest.raises(KeyError):
            number_rows(df, ["session_id"], ["at"], chunk_rows=chunk).running(head=("collect", F.col("at")))


@pytest.mark.parametrize("chunk", [5, 100_000])
def test_quantiles(spark, chunk):
    from trajlens.operators.stats import quantiles
    import numpy as np
    values = {"x": [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0], "y": [7.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "g string, v double")
    out = quantiles(df, ["g"], "v", {"q1": 0.25, "q9": 0.9}, chunk).collect()
    for r in out:
        assert r["n"] == len(values[r["g"]])
        assert r["q1"] == pytest.approx(np.percentile(values[r["g"]], 25))
        assert r["q9"] == pytest.approx(np.percentile(values[r["g"]], 90))


@pytest.mark.parametrize("name", ["sliding_entropy", "detect_stall", "kruskal_wallis", "phase_machine", "stale_reads", "metric_anomalies"])
def test_a_stated_longest_session_needs_no_job_to_plan(spark, name):
    from trajlens.plans import QUERIES
    from trajlens.sequence import LONGEST_SETTING

    spark.sparkContext.setJobGroup(f"plan-{name}", name)
    spark.conf.set(LONGEST_SETTING, "1000")
    try:
        QUERIES[name](spark, "/root/testdata/sf0.001")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"plan-{name}")
    finally:
        spark.conf.unset(LONGEST_SETTING)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Reading a table's schema is a job of its own; nothing is counted.
    assert len(jobs) <= 2
