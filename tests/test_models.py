"""Models against closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlens.operators import models as md


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=120) > 0).astype(float)
    z = x @ [1.0, -2.0, 0.0] + 0.1 * rng.normal(size=120)
    rows = [(i, *map(float, x[i]), float(y[i]), float(z[i])) for i in range(120)]
    df = md.with_folds(spark.createDataFrame(rows, "id long, a double, b double, c double, y double, z double"), "id").cache()
    folds = {r["id"]: r["fold"] for r in df.select("id", "fold").collect()}
    return df, x, y, z, np.array([folds[i] for i in range(120)])


def test_ridge_matches_closed_form(data):
    df, x, _, z, fold = data
    scores = []
    for f in range(5):
        tr, te = fold != f, fold == f
        mu, sd = x[tr].mean(0), x[tr].std(0)
        xs, xt = (x[tr] - mu) / sd, (x[te] - mu) / sd
        b = np.linalg.solve(xs.T @ xs + np.eye(3), xs.T @ (z[tr] - z[tr].mean()))
        pred = z[tr].mean() + xt @ b
        scores.append(1 - ((z[te] - pred) ** 2).sum() / ((z[te] - z[te].mean()) ** 2).sum())
    assert md.ridge_cv(df, ["a", "b", "c"], ["z"])["z"] == pytest.approx(np.mean(scores), abs=1e-9)


def test_logistic_matches_newton(data):
    df, x, y, _, fold = data
    got = {}
    for r in md.logistic_cv(df, "id", ["a", "b", "c"], "y").collect():
        got.setdefault(r["fold"], []).append(r["score"])
    for f in range(5):
        tr = fold != f
        mu, sd = x[tr].mean(0), x[tr].std(0)
        xs = np.column_stack([np.ones(tr.sum()), (x[tr] - mu) / sd])
        w = np.zeros(4)
        pen = np.diag([0.0, 1, 1, 1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-xs @ w))
            w -= np.linalg.solve(xs.T @ (xs * (p * (1 - p))[:, None]) + pen, xs.T @ (p - y[tr]) + pen @ w)
        want = 1 / (1 + np.exp(-(w[0] + ((x[~tr] - mu) / sd) @ w[1:])))
        assert sorted(got[f]) == pytest.approx(sorted(want), abs=1e-6)


def test_auc(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.4, 0.0), (0.4, 1.0), (0.8, 1.0)], "score double, y double")
    assert md.rank_auc(df, []).first()["auc"] == pytest.approx(0.875)


def test_null_and_gain(data):
    df = data[0]
    out = md.null_test(df, "id", ["a", "b"], "y", 20).first()
    assert out["auc"] > 0.8 and out["above_null"] and out["replicates"] == 20
    base, full = md.logistic_cv(df, "id", ["c"], "y"), md.logistic_cv(df, "id", ["a", "c"], "y")
    gain = md.decision(md.bootstrap_auc_gain(base, full, 50), 0.03).first()
    assert gain["low"] > 0 and gain["low"] < gain["gain"] < gain["high"] and gain["decision"] == "supported"


def test_bootstrap_is_repeatable(data):
    df = data[0]
    first = md.bootstrap_means(df, "id", ["a", "z"], 60).orderBy("name").collect()
    again = md.bootstrap_means(df.repartition(7), "id", ["a", "z"], 60).orderBy("name").collect()
    for p, q in zip(first, again):
        assert p["low"] == pytest.approx(q["low"]) and p["low"] < p["mean"] < p["high"]


def test_binomial(spark):
    df = spark.createDataFrame([(9, 10)], "hits int, total int")
    row = md.binomial_test(df, "hits", "total", 0.5).first()
    assert row["p_value"] == pytest.approx(11 / 1024) and row["low"] == pytest.approx(0.6058, abs=1e-3)


def test_binomial_tail_equals_the_sum():
    from math import exp, lgamma, log

    rnd = np.random.default_rng(1)
    for _ in range(300):
        n = int(rnd.integers(1, 300))
        x, p = int(rnd.integers(1, n + 1)), float(rnd.random() * 0.98 + 0.01)
        want = sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(x, n + 1))
        assert float(md.binomial_tail(x, n, p)) == pytest.approx(want, abs=1e-11)
    assert md.binomial_tail(600_000, 1_000_000, 0.5) < 1e-300 and md.binomial_tail([0, 3], [5, 2], [0.5, 0.5]).tolist() == [1.0, 0.0]


def test_selection_key_matches_digest(spark):
    import hashlib
    from trajlens.functions.text import selection_key
    got = spark.createDataFrame([("i1", "m1")], "i string, m string").select(selection_key(F.col("i"), F.col("m"))).first()[0]
    assert got == hashlib.blake2b(b"20260515|i1|m1").hexdigest()[:16]
