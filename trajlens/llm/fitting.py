"""The bounded sample of labelled documents that the classifiers are fitted on."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import held_out

#: Labelled documents a classifier is fitted on at most; their ids and labels take 320 KB.
FIT_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, text, label`` of up to ``rows`` labelled documents that are not held out.

    Of more, those with the smallest hashes of the id are taken, so that the
    choice is the same in every run. A null label is none; of labels that
    contradict each other the larger counts. Texts that are null are empty.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max("label").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The sample has ``rows`` rows of two numbers at most, so the texts need not move.
    return texts.join(F.broadcast(known), "doc_id")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Weights of a logistic regression, the last for the constant, by Newton's method to convergence."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w
