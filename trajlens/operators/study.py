"""Outcome models on numeric and named features, and the decision a study takes from them.

A named feature is a level of a category (value 1) or a count under a name, such
as the calls of one tool. Names are learnt from the rows: a row holds those it
has, so hundreds of tools or models cost what their rows hold. The fit sends the
weights to the rows and gets gradients back, as many numbers as there are
features, for all folds and null labels in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.operators.models import permutation_cuts, rank_auc, uniform
from trajlens.sequence import number_rows
from trajlens.session import durable

#: Names a model may have; their weights are sent to every task.
MAX_NAMES = 200_000
#: Rows a task of a pass takes at least, and numbers that the tasks of a pass may send to the driver without being added up by Spark.
TASK_ROWS, SENT_NUMBERS = 50_000, 2_000_000
BLOCK = 128   # names, the heaviest, whose products are summed


def stratified_folds(df: DataFrame, ident: str, label: str, k: int = 5) -> DataFrame:
    """A ``fold`` per row; each fold holds the labels in the shares of the whole, to one row.

    Rows of one label are dealt out in turn by the SHA-256 of their id, so the folds do not depend on the order of the table.
    """
    rows = df.withColumn("_sha", F.sha2(F.col(ident).cast("string"), 256))
    dealt = number_rows(rows, [label], ["_sha"], "_turn").df
    return dealt.withColumn("fold", F.pmod(F.col("_turn") - 1, F.lit(k)).cast("int")).drop("_sha", "_turn")


def one_hot(*columns: str) -> Column:
    """The named features of categories: ``column=level`` with 1; null is a level of its own."""
    return F.array(*[F.struct(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))).alias("name"), F.lit(1.0).alias("value")) for c in columns])


def counted(df: DataFrame, ident: str, name: str, prefix: str) -> DataFrame:
    """``ident, named``: how often each ``name`` occurs under an id, as named features."""
    per = df.where(F.col(name).isNotNull()).groupBy(ident, name).agg(F.count("*").cast("double").alias("value"))
    return per.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit(f"{prefix}="), F.col(name)).alias("name"), "value"))).alias("named"))


def known_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, level, fold, rows, known``: of each level how many rows a fold holds out, and whether its training rows have it."""
    long = df.select("fold", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("level")) for c in columns])).alias("_l"))
    per = long.groupBy("_l.column", "_l.level", "fold").agg(F.count("*").alias("rows"))
    total = per.groupBy("column", "level").agg(F.sum("rows").alias("_all"))
    return per.join(total, ["column", "level"]).select("column", "level", "fold", "rows", (F.col("_all") > F.col("rows")).alias("known"))


def least(evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], problems: int, size: int, iterations: int = 200, tolerance: float = 1e-4, memory: int = 10) -> np.ndarray:
    """Minima of many convex functions at once, by limited-memory quasi-Newton steps with halving.

    ``evaluate`` gives the values and gradients of all of them in one call.
    """
    w = np.zeros((problems, size))
    value, grad = evaluate(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    dot = lambda a, b: np.einsum("ps,ps->p", a, b)
    inverse = lambda x, squares: np.where(x > 1e-12 * np.sqrt(squares), 1 / np.maximum(x, 1e-300), 0.0)
    for _ in range(iterations):
        if np.abs(grad).max() < tolerance:
            return w
        q, alphas = grad.copy(), []
        curved = [(s, y, inverse(dot(s, y), dot(s, s) * dot(y, y))) for s, y in steps]
        for s, y, rho in reversed(curved):
            a = rho * dot(s, q)
            alphas.append(a)
            q -= a[:, None] * y
        if steps:
            s, y, rho = curved[-1]
            q *= np.where(rho > 0, dot(s, y) / np.maximum(dot(y, y), 1e-300), 1.0)[:, None]
        else:
            q /= np.maximum(1.0, np.sqrt(dot(grad, grad)))[:, None]
        for (s, y, rho), a in zip(curved, reversed(alphas)):
            q += (a - rho * dot(y, q))[:, None] * s
        q = np.where((dot(grad, q) > 0)[:, None], q, grad)
        # Those that have settled rest.
        q = np.where((np.abs(grad).max(1) < tolerance)[:, None], 0.0, q)
        slope = dot(grad, q)
        length = np.ones(problems)
        for _ in range(40):
            tried = w - length[:, None] * q
            new_value, new_grad = evaluate(tried)
            fine = new_value <= value - 1e-4 * length * slope + 1e-9 * np.abs(value)
            if fine.all():
                break
            length = np.where(fine, length, length / 2)
        steps = [*steps, (tried - w, new_grad - grad)][-memory:]
        w, value, grad = tried, new_value, new_grad
    raise RuntimeError(f"the fit has not settled after {iterations} steps")


class _Rows:
    """A batch as arrays: numeric values, and the named ones as (row, name, value) in the order of rows and of names."""

    def __init__(self, pdf: pd.DataFrame, numeric: int):
        self.h, self.fold, self.y = pdf["_h"].to_numpy(), pdf["fold"].to_numpy(), pdf["_y"].to_numpy()
        self.x = np.array(pdf["_x"].tolist(), float).reshape(len(pdf), numeric)
        sizes = pdf["_at"].map(len).to_numpy()
        self.row = np.repeat(np.arange(len(pdf)), sizes)
        self.at = np.concatenate(pdf["_at"].tolist()).astype(int) if sizes.sum() else np.empty(0, int)
        self.value = np.concatenate(pdf["_v"].tolist()).astype(float) if sizes.sum() else np.empty(0)
        self.order = np.argsort(self.at, kind="stable")

    @staticmethod
    def _sums(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, values.shape[1]))
        if len(keys):
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            out[keys[first]] = np.add.reduceat(values, first, axis=0)
        return out

    def logits(self, w: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
        """Rows x problems; weights are constant, numeric, named."""
        q = self.x.shape[1]
        dense = ((self.x - mean) / sd) @ w[:, 1:1 + q].T + w[:, 0]
        return dense + self._sums(self.row, w[:, 1 + q:].T[self.at] * self.value[:, None], len(self.h))

    def gradient(self, off: np.ndarray, mean: np.ndarray, sd: np.ndarray, names: int) -> np.ndarray:
        named = self._sums(self.at[self.order], (off[self.row] * self.value[:, None])[self.order], names)
        return np.vstack([off.sum(0), ((self.x - mean) / sd).T @ off, named]).T


def curvature_roots(data: DataFrame, block: np.ndarray, q: int, size: int, mean: np.ndarray, sd: np.ndarray, penalty: np.ndarray, tasks: int) -> np.ndarray:
    """Per fold a root of the inverse of the bound on the curvature in the ``block`` of weights: a quarter of the training rows' products, and the penalty.

    It depends on the features alone, so all replicates share it. Tasks send sums of products.
    """
    k, b = len(mean), len(block)
    place = np.full(size, -1)
    place[block] = np.arange(b)

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, b, b))
        for pdf in batches:
            batch = _Rows(pdf, q)
            dense = np.zeros((len(pdf), b))
            dense[:, 0], dense[:, 1:1 + q] = 1, batch.x
            at = place[1 + q + batch.at]
            here = at >= 0
            np.add.at(dense, (batch.row[here], at[here]), batch.value[here])
            for f in range(k):
                held = dense[batch.fold == f]
                total[f] += held.T @ held
        flat = total.ravel()
        cells = np.flatnonzero(flat)
        yield pd.DataFrame({"cell": cells, "v": flat[cells]})

    got = data.mapInPandas(reduce_rows, "cell long, v double")
    if tasks * k * b * b > SENT_NUMBERS:
        got = got.groupBy("cell").agg(F.sum("v").alias("v"))
    got = got.toPandas()
    held = np.bincount(got["cell"].to_numpy(np.int64), got["v"].to_numpy(float), minlength=k * b * b).reshape(k, b, b)
    roots = np.zeros((k, b, b))
    for f in range(k):
        turn = np.eye(b)
        turn[range(1, 1 + q), range(1, 1 + q)] = 1 / sd[f]
        turn[0, 1:1 + q] = -mean[f] / sd[f]
        bound = 0.25 * turn.T @ (held.sum(0) - held[f]) @ turn + np.diag(penalty)
        bound += 1e-9 * np.diag(np.diag(bound) + 1)
        roots[f] = np.linalg.inv(np.linalg.cholesky(bound)).T
    return roots


def named_logistic(df: DataFrame, ident: str, label: str, numeric: Sequence[str] = (), named: Column | None = None, null_replicates: int = 0, k: int = 5) -> DataFrame:
    """Out-of-fold scores ``id_hash, replicate, fold, y, score`` of L2 logistic regression.

    ``df`` has a ``fold``. Numeric columns are standardised per training fold (null
    is 0); a name that no training row of a fold has keeps the weight 0 there, so
    it says nothing about that fold's rows. The penalty is half the squared weights,
    without the constant, on the summed loss. Replicate 0 has the real labels, the
    others permute them.
    """
    q = len(numeric)
    entries = F.coalesce(named, F.array()) if named is not None else F.array().cast("array<struct<name:string,value:double>>")
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric]).cast("array<double>")
    rows = durable(df.where(F.col(label).isNotNull()).select(F.xxhash64(F.col(ident)).alias("_h"), "fold", F.col(label).cast("double").alias("_y"), x.alias("_x"), entries.alias("_n")))
    found = rows.select(F.explode("_n").alias("e")).select("e.name").distinct().limit(MAX_NAMES + 1).collect()
    if len(found) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names: drop rare ones first")
    index = {name: i for i, name in enumerate(sorted(r.name for r in found))}
    size = 1 + q + len(index)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["_at"] = [[index[e["name"]] for e in es] for es in pdf["_n"]]
            pdf["_v"] = [[e["value"] for e in es] for es in pdf["_n"]]
            yield pdf.drop(columns="_n")

    data = durable(rows.mapInPandas(encode, "_h long, fold int, _y double, _x array<double>, _at array<int>, _v array<double>"))
    tasks = min(max(1, -(-data.count() // TASK_ROWS)), data.rdd.getNumPartitions())
    data = data.coalesce(tasks)
    sums = {r.fold: r for r in data.select("fold", F.posexplode("_x")).groupBy("fold", "pos").agg(F.count("*").alias("n"), F.sum("col").alias("s"), F.sum(F.col("col") ** 2).alias("ss"))
            .groupBy("fold").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "s", "ss"))).alias("m")).collect()} if q else {}
    mean, sd = np.zeros((k, q)), np.ones((k, q))
    for f in range(k if q else 0):
        train = [r for g, r in sums.items() if g != f]
        n = max(1, sum(r.n for r in train))
        s, ss = (sum((np.array([m[c] for m in r.m]) for r in train), np.zeros(q)) for c in ("s", "ss"))
        mean[f] = s / n
        sd[f] = np.sqrt(np.maximum(ss / n - mean[f] ** 2, 0))
    sd[sd < 1e-12] = 1.0
    r = null_replicates + 1
    cuts = permutation_cuts(data.select("_h", "_y"), null_replicates)

    def labels(rows: _Rows) -> np.ndarray:
        return np.column_stack([rows.y, *((uniform(rows.h, b) < cuts[b - 1]).astype(float) for b in range(1, r))])

    penalty = np.ones(size)
    penalty[0] = 0.0

    def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = w.reshape(k, r, size)

        def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, r, size + 1))
            for pdf in batches:
                batch = _Rows(pdf, q)
                ys = labels(batch)
                for f in range(k):
                    z = batch.logits(weights[f], mean[f], sd[f])
                    train = (batch.fold != f)[:, None]
                    total[f, :, 0] += (train * (np.logaddexp(0, z) - ys * z)).sum(0)
                    total[f, :, 1:] += batch.gradient(train * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - ys), mean[f], sd[f], len(index))
            flat = total.ravel()
            cells = np.flatnonzero(flat)
            yield pd.DataFrame({"cell": cells, "v": flat[cells]})

        cells = k * r * (size + 1)
        got = data.mapInPandas(reduce_rows, "cell long, v double")
        if tasks * cells > SENT_NUMBERS:
            got = got.groupBy("cell").agg(F.sum("v").alias("v"))
        got = got.toPandas()
        flat = np.bincount(got["cell"].to_numpy(np.int64), got["v"].to_numpy(float), minlength=cells)
        flat = flat.reshape(k * r, size + 1)
        return flat[:, 0] + 0.5 * (penalty * w * w).sum(1), flat[:, 1:] + penalty * w

    # Half the root of a feature's squares bounds its curvature; in that scale, one step suits all features apart.
    squares = np.full(size, float(max(1, data.count())))
    for row in data.select(F.explode(F.arrays_zip("_at", "_v")).alias("e")).groupBy("e._at").agg(F.sum(F.col("e._v") ** 2).alias("s")).collect():
        squares[1 + q + row["_at"]] = row["s"]
    scale = 1 / np.sqrt(0.25 * squares + penalty)
    # Features that nearly add up to each other, as counts and their total do, need their products as well.
    block = np.concatenate([np.arange(1 + q), 1 + q + np.argsort(-squares[1 + q:], kind="stable")[:BLOCK]])
    roots = curvature_roots(data, block, q, size, mean, sd, penalty[block], tasks)

    def unscaled(v: np.ndarray, turned: np.ndarray) -> np.ndarray:
        out = v * scale
        out.reshape(k, r, size)[:, :, block] = v.reshape(k, r, size)[:, :, block] @ turned
        return out

    def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, grad = evaluate(unscaled(v, roots.transpose(0, 2, 1)))
        return value, unscaled(grad, roots)

    final = unscaled(least(scaled, k * r, size, tolerance=1e-5), roots.transpose(0, 2, 1)).reshape(k, r, size)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            batch = _Rows(pdf, q)
            ys, out = labels(batch), np.zeros((len(pdf), r))
            for f in range(k):
                mine = batch.fold == f
                out[mine] = 1 / (1 + np.exp(-np.clip(batch.logits(final[f], mean[f], sd[f])[mine], -700, 700)))
            yield pd.DataFrame({"id_hash": np.repeat(batch.h, r), "replicate": np.tile(np.arange(r), len(pdf)), "fold": np.repeat(batch.fold, r),
                                "y": ys.ravel(), "score": np.round(out.ravel(), 6)})

    return data.mapInPandas(score, "id_hash long, replicate int, fold int, y double, score double")


def above_null(scores: DataFrame, floor: float = 0.55) -> DataFrame:
    """``auc, null_p95, null_mean, replicates, passes``: the mean AUC over folds, against its null and a floor.

    A fold of one class has no AUC; stratified folds have both as soon as each class has as many rows as there are folds.
    """
    per = rank_auc(scores, ["replicate", "fold"]).groupBy("replicate").agg(F.avg("auc").alias("auc"))
    null = F.when(F.col("replicate") > 0, F.col("auc"))
    out = per.agg(F.max(F.when(F.col("replicate") == 0, F.col("auc"))).alias("auc"), F.percentile(null, F.lit(0.95)).alias("null_p95"),
                  F.avg(null).alias("null_mean"), F.count(null).alias("replicates"))
    return out.withColumn("passes", (F.col("auc") > F.col("null_p95")) & (F.col("auc") >= floor))


# What the two tests decide.
DECISIONS = ("H1_FAIL", "H1_PASS_H2_FAIL", "H1_PASS_H2_PASS")


def decide(signal: DataFrame, gain: DataFrame, least_gain: float = 0.03) -> DataFrame:
    """One row: both tests and the code of the decision; the gain counts where it reaches ``least_gain`` and its interval lies above 0."""
    one = F.lit(1).alias("_one")
    both = signal.select(one, "auc", "null_p95", F.col("passes").alias("signal")).join(gain.select(one, "auc_base", "auc_full", "gain", "low", "high"), "_one").drop("_one")
    adds = (F.col("gain") >= least_gain) & (F.col("low") > 0)
    code = F.when(~F.col("signal"), DECISIONS[0]).when(~adds, DECISIONS[1]).otherwise(DECISIONS[2])
    return both.withColumns({"adds": adds, "decision": code})
