"""Models on named features against dense one-hot matrices, folds and decisions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlens.operators import study as sd


def _newton(x, y):
    """L2 logistic regression, constant first and unpenalised."""
    w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1])
    penalty[0, 0] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T * (p * (1 - p)) @ x + penalty + 1e-12 * np.eye(len(w)), x.T @ (p - y) + penalty @ w)
    return w


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for i in range(240):
        tool, length = rnd.choice(["a", "b", "c", "d"]), rnd.randint(1, 40)
        y = int(rnd.random() < (0.8 if tool == "a" else 0.3))
        rare = f"only{i}" if i % 40 == 0 else rnd.choice(["x", None])
        data.append((i, tool, rare, float(length), None if i % 11 == 0 else rnd.random(), y, [(f"n={j}", float(rnd.randint(1, 3))) for j in range(rnd.randint(0, 3))]))
    df = spark.createDataFrame(data, "id long, tool string, rare string, length double, gap double, y int, named array<struct<name:string,value:double>>").repartition(3)
    return sd.stratified_folds(df, "id", "y").cache()


def test_folds_hold_each_label_alike(rows):
    counts = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    for y in (0, 1):
        sizes = [counts[f, y] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("limits", [(50_000, 2_000_000), (40, 0)])
def test_scores_equal_dense_one_hot_fits(rows, monkeypatch, limits):
    """Levels no training row has say nothing about the held-out rows that have them."""
    monkeypatch.setattr(sd, "TASK_ROWS", limits[0])
    monkeypatch.setattr(sd, "SENT_NUMBERS", limits[1])
    got = {r.id_hash: r.score for r in sd.named_logistic(rows, "id", "y", ["length", "gap"], F.concat(sd.one_hot("tool", "rare"), "named")).collect()}
    data = rows.withColumn("h", F.xxhash64("id")).collect()
    for fold in range(5):
        train, held = [r for r in data if r.fold != fold], [r for r in data if r.fold == fold]
        names = lambda r: {f"tool={r.tool}": 1.0, f"rare={r.rare}": 1.0, **{n.name: n.value for n in r.named}}
        known = sorted({n for r in train for n in names(r)})
        numeric = lambda some: np.array([[r.length, r.gap or 0.0] for r in some])
        mean, std = numeric(train).mean(0), numeric(train).std(0)
        dense = lambda some: np.column_stack([np.ones(len(some)), (numeric(some) - mean) / std, [[names(r).get(n, 0.0) for n in known] for r in some]])
        w = _newton(dense(train), np.array([r.y for r in train]))
        want = 1 / (1 + np.exp(-dense(held) @ w))
        assert np.abs(want - [got[r.h] for r in held]).max() < 1e-4


def test_signal_beyond_the_null_and_decisions(spark, rows):
    scores = sd.named_logistic(rows, "id", "y", [], sd.one_hot("tool"), 19)
    signal = sd.above_null(scores).first()
    assert signal.passes and signal.auc > 0.65 and 0.4 < signal.null_mean < 0.6 and signal.replicates == 19
    noise = sd.above_null(sd.named_logistic(rows, "id", "y", ["gap"], None, 19)).first()
    assert not noise.passes
    table = lambda ok: spark.createDataFrame([(0.7, 0.6, ok)], "auc double, null_p95 double, passes boolean")
    gain = lambda g, low: spark.createDataFrame([(0.6, 0.6 + g, g, low, g + 0.1)], "auc_base double, auc_full double, gain double, low double, high double")
    code = lambda *x: sd.decide(*x).first().decision
    assert code(table(False), gain(0.1, 0.05)) == "H1_FAIL"
    assert code(table(True), gain(0.1, -0.01)) == code(table(True), gain(0.02, 0.01)) == "H1_PASS_H2_FAIL"
    assert code(table(True), gain(0.05, 0.01)) == "H1_PASS_H2_PASS"


def test_steps_reach_the_least_of_many_functions():
    rnd = np.random.default_rng(1)
    a = rnd.normal(size=(7, 12, 12))
    a = np.einsum("pij,pkj->pik", a, a) + np.eye(12)
    b = rnd.normal(size=(7, 12))
    w = sd.least(lambda w: (0.5 * np.einsum("pi,pij,pj->p", w, a, w) - np.einsum("pi,pi->p", b, w), np.einsum("pij,pj->pi", a, w) - b), 7, 12, tolerance=1e-7)
    assert np.abs(w - np.linalg.solve(a, b[..., None])[..., 0]).max() < 1e-5


def test_many_names_are_refused_and_none_are_fine(rows, monkeypatch):
    assert sd.named_logistic(rows, "id", "y", ["length"]).count() == 240
    monkeypatch.setattr(sd, "MAX_NAMES", 3)
    with pytest.raises(ValueError):
        sd.named_logistic(rows, "id", "y", [], sd.one_hot("tool"))


def test_counts_that_add_up_to_a_total_settle(spark):
    """Length, its parts and their names are nearly one feature."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(400):
        n = rng.integers(5, 60, 5)
        data.append((i, int(i % 2), float(n.sum() + (i % 3 == 0)), float(n[4]), [(f"t{j}", float(c)) for j, c in enumerate(n)]))
    df = spark.createDataFrame(data, "id long, y int, events double, errors double, named array<struct<name:string,value:double>>")
    rows = sd.stratified_folds(df, "id", "y")
    scores = sd.named_logistic(rows, "id", "y", ["events", "errors"], F.col("named"), 2)
    assert scores.count() == 3 * 400
