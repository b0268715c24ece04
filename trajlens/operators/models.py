"""Cross-validated models, permutation nulls and bootstrap intervals.

Rows never leave the cluster: each task reduces its rows to sums of fixed size
(moments, gradients, replicate totals), Spark adds those up, and only the sums,
whose size depends on the number of features and replicates, reach the driver.
Folds, labels of the null and bootstrap weights are functions of the row id, so a
task that runs again produces the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlens.operators.stats import average_ranks

SEED = 20260515
_CELLS = "fold int, cell int, v double"


def with_folds(df: DataFrame, ident: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """A fold per row from its id."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(ident)), F.lit(k)).cast("int"))


def uniform(ids: np.ndarray, replicate: int, seed: int = SEED) -> np.ndarray:
    """Reproducible uniform numbers of (id, replicate), by the splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((replicate + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) if k else np.exp(-1.0) for k in range(12)])


def bootstrap_weights(ids: np.ndarray, replicates: int) -> np.ndarray:
    """Rows x replicates of Poisson(1) counts: how often a row is drawn in each replicate."""
    return np.stack([np.searchsorted(_POISSON, uniform(ids, b)) for b in range(replicates)], axis=1).astype(float)


def _summed(df: DataFrame, reduce_rows, schema: str, keys: Sequence[str]) -> DataFrame:
    """Per-task sums of fixed size, added up over tasks."""
    return df.mapInPandas(reduce_rows, schema).groupBy(*keys).agg(F.sum("v").alias("v"))


def fold_moments(df: DataFrame, columns: Sequence[str], k: int = 5) -> np.ndarray:
    """Per fold the matrix of sums of products of (1, columns)."""
    cols = list(columns)
    p = len(cols) + 1

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, p, p))
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(float)])
            fold = pdf["fold"].to_numpy()
            for f in range(k):
                part = z[fold == f]
                total[f] += part.T @ part
        yield pd.DataFrame({"fold": np.repeat(np.arange(k), p * p), "cell": np.tile(np.arange(p * p), k), "v": total.ravel()})

    out = np.zeros((k, p * p))
    for row in _summed(df.select("fold", *cols), reduce_rows, _CELLS, ["fold", "cell"]).collect():
        out[row["fold"], row["cell"]] = row["v"]
    return out.reshape(k, p, p)


def ridge_fit(moments: np.ndarray, n_features: int, alpha: float = 1.0) -> np.ndarray:
    """Coefficients (intercept first) for each target column, features standardised."""
    n = moments[0, 0]
    q = n_features
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:q] / n, 0))
    sd[sd == 0] = 1.0
    gram = cov[:q, :q] / np.outer(sd, sd)
    coef = np.linalg.solve(gram + alpha * np.eye(q), cov[:q, q:] / sd[:, None]) / sd[:, None]
    return np.vstack([mean[q:] - mean[:q] @ coef, coef])


def ridge_cv(df: DataFrame, features: Sequence[str], targets: Sequence[str], k: int = 5,
             alpha: float = 1.0) -> dict[str, float | None]:
    """Mean cross-validated R2 of each target on the features, from one pass over the rows.

    The held-out squared error follows from the held-out moments alone. A target that
    does not vary has no score: its value is None, and so is that of one that varies in
    no held-out fold.
    """
    m = fold_moments(df, [*features, *targets], k)
    q = len(features)
    scores: dict[str, list[float]] = {t: [] for t in targets}
    for f in range(k):
        held, train = m[f], m.sum(axis=0) - m[f]
        if held[0, 0] == 0:
            continue
        beta = ridge_fit(train, q, alpha)
        for i, t in enumerate(targets):
            at = 1 + q + i
            sst = held[at, at] - held[0, at] ** 2 / held[0, 0]
            b = beta[:, i]
            xx, xy = held[:1 + q, :1 + q], held[:1 + q, at]
            sse = held[at, at] - 2 * b @ xy + b @ xx @ b
            if sst > 1e-12:
                scores[t].append(1 - sse / sst)
    return {t: float(np.mean(s)) if s else None for t, s in scores.items()}


def ridge_out_of_fold(df: DataFrame, features: Sequence[str], target: str, k: int = 5, alpha: float = 1.0) -> DataFrame:
    """Each row's prediction by the model that did not see its fold."""
    m = fold_moments(df, [*features, target], k)
    total = m.sum(axis=0)
    chain = F
    for f in range(k):
        b = ridge_fit(total - m[f], len(features), alpha)[:, 0]
        value = F.lit(float(b[0]))
        for w, c in zip(b[1:], features):
            value = value + F.lit(float(w)) * F.col(c)
        chain = chain.when(F.col("fold") == f, value)
    return df.withColumn("score", chain)


def permutation_cuts(rows: DataFrame, replicates: int, parts: int = 1024) -> np.ndarray:
    """For each null replicate, the number below which as many rows lie as have a positive label.

    Labelling those rows permutes the labels. Each pass counts the rows in ``parts``
    parts of what is left of each replicate's range, so what reaches the driver does
    not grow with the rows. Rows of equal ids go together.
    """
    if not replicates:
        return np.empty(0)
    wanted = np.full(replicates, float(rows.agg(F.sum("_y")).first()[0] or 0))
    low, width = np.zeros(replicates), 1.0
    for _ in range(6):   # 1024 ** 6 exceeds the 2 ** 53 different numbers
        start, step = low.copy(), width / parts

        def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros((replicates, parts + 1))
            for pdf in batches:
                h = pdf["_h"].to_numpy()
                for b in range(replicates):
                    at = np.floor((uniform(h, b + 1) - start[b]) / step)
                    acc[b] += np.bincount(at[(at >= 0) & (at < parts)].astype(int), minlength=parts + 1)
            b, cell = np.nonzero(acc)
            yield pd.DataFrame({"fold": b, "cell": cell, "v": acc[b, cell]})

        counts = np.zeros((replicates, parts))
        for row in _summed(rows.select("_h"), reduce_rows, _CELLS, ["fold", "cell"]).collect():
            counts[row["fold"], row["cell"]] = row["v"]
        upto = counts.cumsum(axis=1)
        # The last boundary with no more rows below it than wanted.
        full = (upto <= wanted[:, None]).sum(axis=1)
        wanted -= np.where(full > 0, upto[np.arange(replicates), np.maximum(full - 1, 0)], 0)
        low = start + full * step
        width = step
        if not wanted.any():
            break
    return low


def logistic_cv(df: DataFrame, ident: str, features: Sequence[str], label: str, null_replicates: int = 0,
                k: int = 5, iterations: int = 200) -> DataFrame:
    """Out-of-fold scores of L2 logistic regression, for the labels and for null labels.

    Features are standardised per training fold and the penalty is half the squared
    weights on the summed loss. All folds and replicates take their Newton step from
    the same pass over the rows, until no weight moves; a fit that has not settled
    after ``iterations`` passes raises. Replicate 0 has the real labels; the others are
    permutations: as many rows are positive, chosen by the row's number in the replicate.
    Result: ``replicate, fold, y, score``.
    """
    cols = list(features)
    m = fold_moments(df, cols, k)
    total = m.sum(axis=0)
    means, sds = [], []
    for f in range(k):
        t = total - m[f]
        mu = t[0, 1:] / t[0, 0]
        sd = np.sqrt(np.maximum(np.diag(t)[1:] / t[0, 0] - mu ** 2, 0))
        means.append(mu)
        sds.append(np.where(sd < 1e-12, 1.0, sd))
    p, r = len(cols) + 1, null_replicates + 1
    rows = df.select(F.xxhash64(F.col(ident)).alias("_h"), "fold", F.col(label).cast("double").alias("_y"), *cols)

    cuts = permutation_cuts(rows, null_replicates)

    def labels(pdf: pd.DataFrame) -> np.ndarray:
        h = pdf["_h"].to_numpy()
        null = [(uniform(h, b) < cuts[b - 1]).astype(float) for b in range(1, r)]
        return np.column_stack([pdf["_y"].to_numpy(), *null])

    def design(pdf: pd.DataFrame, f: int) -> np.ndarray:
        x = (pdf[cols].to_numpy(float) - means[f]) / sds[f]
        return np.column_stack([np.ones(len(x)), x])

    weights = np.zeros((k, r, p))
    width = p + p * p
    for _ in range(iterations):
        current = weights.copy()

        def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros((k, r, width))
            for pdf in batches:
                ys, fold = labels(pdf), pdf["fold"].to_numpy()
                for f in range(k):
                    train = fold != f
                    x, y = design(pdf, f)[train], ys[train]
                    prob = 1 / (1 + np.exp(-np.clip(x @ current[f].T, -30, 30)))
                    acc[f, :, :p] += (x.T @ (prob - y)).T
                    acc[f, :, p:] += np.einsum("ni,nr,nj->rij", x, prob * (1 - prob), x, optimize=True).reshape(r, -1)
            yield pd.DataFrame({"fold": np.repeat(np.arange(k), r * width), "cell": np.tile(np.arange(r * width), k), "v": acc.ravel()})

        sums = np.zeros((k, r * width))
        for row in _summed(rows, reduce_rows, _CELLS, ["fold", "cell"]).collect():
            sums[row["fold"], row["cell"]] = row["v"]
        sums = sums.reshape(k, r, width)
        penalty = np.eye(p)
        penalty[0, 0] = 0.0
        moved = 0.0
        for f in range(k):
            for b in range(r):
                grad = sums[f, b, :p] + penalty @ weights[f, b]
                hess = sums[f, b, p:].reshape(p, p) + penalty + 1e-9 * np.eye(p)
                step = np.linalg.solve(hess, grad)
                weights[f, b] -= step
                moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    else:
        raise RuntimeError(f"the logistic fit has not settled after {iterations} passes")
    final = weights

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ys, fold = labels(pdf), pdf["fold"].to_numpy()
            out = np.zeros((len(pdf), r))
            for f in range(k):
                mine = fold == f
                out[mine] = 1 / (1 + np.exp(-np.clip(design(pdf, f)[mine] @ final[f].T, -30, 30)))
            yield pd.DataFrame({
                "id_hash": np.repeat(pdf["_h"].to_numpy(), r), "replicate": np.tile(np.arange(r), len(pdf)),
                "fold": np.repeat(fold, r), "y": ys.ravel(), "score": np.round(out.ravel(), 9)})

    return rows.mapInPandas(score, "id_hash long, replicate int, fold int, y double, score double")


def rank_auc(scores: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their average rank."""
    ranked = average_ranks(scores, keys, score, "_rank")
    pos = F.col(y) > 0
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.when(pos, F.col("_rank"))).alias("_r"), F.count(F.when(pos, 1)).cast("double").alias("_p"),
        F.count(F.when(~pos, 1)).cast("double").alias("_n"))
    auc = (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * F.col("_n"))
    return sums.select(*keys, F.when((F.col("_p") > 0) & (F.col("_n") > 0), auc).alias("auc"))


def null_test(df: DataFrame, ident: str, features: Sequence[str], label: str, replicates: int) -> DataFrame:
    """Cross-validated AUC against the 95th percentile of the null replicates."""
    per_fold = rank_auc(logistic_cv(df, ident, features, label, replicates), ["replicate", "fold"])
    per = per_fold.groupBy("replicate").agg(F.avg("auc").alias("auc"))
    null = F.when(F.col("replicate") > 0, F.col("auc"))
    return per.agg(F.max(F.when(F.col("replicate") == 0, F.col("auc"))).alias("auc"), F.percentile(null, F.lit(0.95)).alias("null_p95"),
                   F.count(null).alias("replicates")).withColumn("above_null", F.col("auc") > F.col("null_p95"))


def bootstrap_auc_gain(base: DataFrame, full: DataFrame, replicates: int) -> DataFrame:
    """Gain in AUC of one set of out-of-fold scores over another with a bootstrap interval.

    Each batch adds up its replicate weights per distinct score and class; only equal
    scores are tied.
    """
    def curve(scores: DataFrame) -> DataFrame:
        def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = np.arange(replicates + 1)
            for pdf in batches:
                w = np.column_stack([np.ones(len(pdf)), bootstrap_weights(pdf["id_hash"].to_numpy(), replicates)])
                used, at = np.unique(pdf["score"].to_numpy(), return_inverse=True)
                acc = np.zeros((2, len(used), replicates + 1))
                np.add.at(acc, (pdf["y"].to_numpy().astype(int), at), w)
                yield pd.DataFrame({"bin": np.repeat(used, len(b)), "b": np.tile(b, len(used)), "neg": acc[0].ravel(), "pos": acc[1].ravel()})

        sums = scores.mapInPandas(reduce_rows, "bin double, b int, neg double, pos double").groupBy("b", "bin").agg(
            F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        below = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        wins = sums.withColumn("_w", F.col("pos") * (below + F.col("neg") / 2))
        return wins.groupBy("b").agg((F.sum("_w") / (F.sum("pos") * F.sum("neg"))).alias("auc"))

    gain = curve(full).withColumnRenamed("auc", "_full").join(curve(base).withColumnRenamed("auc", "_base"), "b")
    d = F.col("_full") - F.col("_base")
    resampled = F.when(F.col("b") > 0, d)
    return gain.agg(
        F.max(F.when(F.col("b") == 0, F.col("_base"))).alias("auc_base"), F.max(F.when(F.col("b") == 0, F.col("_full"))).alias("auc_full"),
        F.max(F.when(F.col("b") == 0, d)).alias("gain"), F.percentile(resampled, F.lit(0.025)).alias("low"),
        F.percentile(resampled, F.lit(0.975)).alias("high"))


def bootstrap_means(df: DataFrame, ident: str, values: Sequence[str], replicates: int, alpha: float = 0.05) -> DataFrame:
    """Mean of each value with a bootstrap interval."""
    cols = list(values)

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((replicates + 1, len(cols) + 1))
        for pdf in batches:
            w = np.column_stack([np.ones(len(pdf)), bootstrap_weights(pdf["_h"].to_numpy(), replicates)])
            acc += w.T @ np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(float)])
        yield pd.DataFrame({"b": np.repeat(np.arange(replicates + 1), len(cols)), "name": np.tile(cols, replicates + 1),
                            "s": acc[:, 1:].ravel(), "n": np.repeat(acc[:, 0], len(cols))})

    rows = df.select(F.xxhash64(F.col(ident)).alias("_h"), *cols)
    sums = rows.mapInPandas(reduce_rows, "b int, name string, s double, n double").groupBy("name", "b").agg(
        (F.sum("s") / F.sum("n")).alias("mean"))
    drawn = F.when(F.col("b") > 0, F.col("mean"))
    return sums.groupBy("name").agg(
        F.max(F.when(F.col("b") == 0, F.col("mean"))).alias("mean"), F.percentile(drawn, F.lit(alpha / 2)).alias("low"),
        F.percentile(drawn, F.lit(1 - alpha / 2)).alias("high"))


def bootstrap_detector_scores(matches: DataFrame, replicates: int) -> DataFrame:
    """Macro precision, recall and F1 with intervals from resampling sessions."""
    cells = matches.groupBy("session_id", "failure").agg(
        F.sum("tp_weight").alias("tp"), F.count(F.when(F.col("match_type") == "fp", 1)).cast("double").alias("fp"),
        F.count(F.when(F.col("match_type") == "fn", 1)).cast("double").alias("fn")).withColumn("_h", F.xxhash64("session_id"))

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            for failure, part in pdf.groupby("failure"):
                w = np.column_stack([np.ones(len(part)), bootstrap_weights(part["_h"].to_numpy(), replicates)])
                acc[failure] = acc.get(failure, 0) + w.T @ part[["tp", "fp", "fn"]].to_numpy(float)
        for failure, s in acc.items():
            yield pd.DataFrame({"failure": failure, "b": np.arange(replicates + 1), "tp": s[:, 0], "fp": s[:, 1], "fn": s[:, 2]})

    sums = cells.select("_h", "failure", "tp", "fp", "fn").mapInPandas(
        reduce_rows, "failure string, b int, tp double, fp double, fn double").groupBy("b", "failure").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).where("tp + fp + fn > 0")
    from trajlens.operators.evaluation import prf
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    macro = sums.groupBy("b").agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f).alias("f1"))
    named = macro.select("b", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("precision", "recall", "f1")])))
    drawn = F.when(F.col("b") > 0, F.col("v"))
    return named.groupBy("metric").agg(F.max(F.when(F.col("b") == 0, F.col("v"))).alias("point"),
                                       F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1, by Stirling's series after shifting to x + 8."""
    shift = sum(np.log(x + i) for i in range(8))
    z = x + 8
    inverse = 1 / (z * z)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def binomial_tail(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= x) of binomial(n, p), as the incomplete beta function by its continued fraction.

    The work does not grow with n.
    """
    x, n, p = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(x, n, p))
    out = np.where(x <= 0, 1.0, np.where(p >= 1, (x <= n).astype(float), 0.0))
    inside = (x > 0) & (x <= n) & (p > 0) & (p < 1)
    if not inside.any():
        return out
    a, b, q = x[inside], (n - x + 1)[inside], p[inside]
    turned = q > (a + 1) / (a + b + 2)   # the fraction converges fast on the other side
    a, b, q = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - q, q)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(q) + b * np.log1p(-q)) / a
    tiny = 1e-300
    c, d = np.ones_like(a), 1 / np.where(np.abs(1 - (a + b) * q / (a + 1)) < tiny, tiny, 1 - (a + b) * q / (a + 1))
    h = d.copy()
    for m in range(1, 10_000):
        before = h.copy()
        for term in (m * (b - m) * q / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * q / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(h - before) <= 1e-15 * np.abs(h)):
            break
    out[inside] = np.clip(np.where(turned, 1 - front * h, front * h), 0, 1)
    return out


def binomial_test(df: DataFrame, hits: str, total: str, p0: float, level: float = 0.95) -> DataFrame:
    """One-sided exact binomial test of ``hits`` in ``total`` against ``p0`` and its lower bound."""
    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, n = pdf[hits].to_numpy(float), pdf[total].to_numpy(float)
            lo, hi = np.zeros(len(x)), np.ones(len(x))
            for _ in range(60):
                mid = (lo + hi) / 2
                below = binomial_tail(x, n, mid) < 1 - level
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
            yield pdf.assign(p_value=binomial_tail(x, n, np.full(len(x), p0)), low=np.where(x > 0, lo, 0.0))

    from pyspark.sql import types as T
    schema = T.StructType([*df.schema.fields, T.StructField("p_value", T.DoubleType()), T.StructField("low", T.DoubleType())])
    return df.mapInPandas(test, schema)


def max_correlations(df: DataFrame, constructs: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Largest absolute correlation of each construct feature with any other feature."""
    aggs = [F.abs(F.corr(c, f)).alias(f"{c}__{f}") for c in constructs for f in features]
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("construct"), F.round(F.array_max(F.array(*[F.coalesce(F.when(~F.isnan(f"{c}__{f}"), F.col(f"{c}__{f}")), F.lit(0.0))
                                                                   for f in features])), 6).alias("max_abs_r")) for c in constructs])))


def decision(gain: DataFrame, floor: float) -> DataFrame:
    """The locked rule on a construct: a gain counts with its interval above 0 and at the caller's floor."""
    return gain.withColumn("decision", F.when((F.col("low") > 0) & (F.col("gain") >= floor), "supported")
                           .when(F.col("low") > 0, "detectable, below floor").otherwise("not supported"))
