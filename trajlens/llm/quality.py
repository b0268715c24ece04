"""Text quality by positive-unlabelled learning with a non-negative unbiased risk.

Trusted positives are documents labelled good; the unlabelled ones stand for
web text and hold an unknown share of good documents. That share, the class
prior, is estimated from how a first classifier ranks both sets. The model is
logistic in features of a text's surface and in their squares.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import held_out
from trajlens.llm.fitting import FIT_ROWS, sigmoid
from trajlens.session import durable

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#$%&*@^~<>{}[]\\_=+"
_MARK = b".,;:!?'\"()-"
_REPEATED = re.compile(rb"(\S)\1\1")
_TAILED = re.compile(rb"[A-Za-z\x80-\xff][,.]?([#$%&*!|@^~])\1+")

NAMES = ("log_bytes", "log_words", "word_bytes", "long_words", "upper", "lower", "digits", "symbols", "marks", "pipes", "exclaims", "high_bytes",
         "distinct_words", "top_word", "second_word", "repeats_before", "distinct_lines", "top_line", "words_a_line", "short_lines", "tripled",
         "tailed", "compressed", "sentence_words", "bare_marks", "capital_words")


def features(text: str) -> list[float]:
    """Surface features of a whole text, each about 0 to 1."""
    raw = text.encode()
    n = len(raw)
    words = raw.split()
    k = len(words)
    if not k:
        return [0.0] * len(NAMES)
    share = lambda chars: 1 - len(raw.translate(None, chars)) / n
    counts = Counter(words).most_common(2)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_counts = Counter(lines).most_common(1)
    same = sum(map(bytes.__eq__, words, words[1:]))
    starts = raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".") + raw.count(b"? ") + raw.count(b"! ")
    upper, lower, digits, symbols, marks = map(share, (_UPPER, _LOWER, _DIGIT, _SYMBOL, _MARK))
    return [min(1.0, np.log1p(n) / 12), min(1.0, np.log1p(k) / 10), min(1.0, (n - k) / k / 15), sum(len(w) > 15 for w in words) / k,
            upper, lower, digits, symbols, marks, min(1.0, 5 * raw.count(b"|") / k), min(1.0, 5 * raw.count(b"!") / k),
            max(0.0, 1 - upper - lower - digits - symbols - marks - (raw.count(b" ") + raw.count(b"\n") + raw.count(b"|")) / n),
            len(set(words)) / k, counts[0][1] / k, counts[1][1] / k if len(counts) > 1 else 0.0, same / k,
            len(set(lines)) / len(lines), line_counts[0][1] / len(lines), min(1.0, k / len(lines) / 100),
            sum(len(x) < 40 for x in lines) / len(lines), min(1.0, 5 * len(_REPEATED.findall(raw)) / k), min(1.0, 5 * len(_TAILED.findall(raw)) / k),
            min(1.0, len(zlib.compress(raw, 1)) / n), min(1.0, k / (starts + 1) / 60), words.count(b"|") / k,
            sum(w[:1] in _UPPER for w in words) / k]


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.c_[z, z * z / 4, np.ones(len(z))]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(expand(x, self.mean, self.scale) @ self.weights)


def minimise_risk(p: np.ndarray, u: np.ndarray, prior: float, ridge: float = 1e-3, steps: int = 1500, rate: float = 0.03) -> np.ndarray:
    """Weights of least non-negative unbiased risk, by Adam.

    The risk is prior * R+(p) + max(0, R-(u) - prior * R-(p)) with the logistic
    loss. Where the part in brackets is negative, the model has begun to call
    trusted positives negative, and the step goes back along that part.
    """
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 0
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        positive = -prior * (p * (1 - sp)[:, None]).mean(0)
        negative = (u * su[:, None]).mean(0) - prior * (p * sp[:, None]).mean(0)
        loss = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        g = (positive + negative if loss >= 0 else -negative) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, least: float = 0.2) -> float:
    """Share of positives among the unlabelled, from scores of both.

    At any cut, positives make up at most the ratio of the unlabelled to the
    positives above it. The estimate is the least such ratio over cuts that
    keep at least the share ``least`` of the positives, with a confidence
    margin for the smaller counts.
    """
    cuts = np.quantile(p, np.linspace(0, 1 - least, 81))
    best = 1.0
    for c in cuts:
        a, b = (p >= c).mean(), (u >= c).mean()
        margin = np.sqrt(b * (1 - b) / len(u)) + b / max(a, 1e-9) * np.sqrt(a * (1 - a) / len(p))
        best = min(best, (b + margin) / max(a, 1e-9))
    return float(np.clip(best, 0.01, 0.99))


def fit_features(p: np.ndarray, u: np.ndarray) -> Model:
    """A model from the features of trusted positives and of unlabelled documents."""
    mean, scale = u.mean(0), np.maximum(u.std(0), 1e-3)
    p, u = expand(p, mean, scale), expand(u, mean, scale)
    # The first classifiers take the unlabelled for negatives; only their ranking is used, and each ranks the half it has not seen:
    # what it has seen it tells apart too well, which would make the prior too small.
    ranks = np.zeros(len(p)), np.zeros(len(u))
    for half in (0, 1):
        seen, other = slice(half, None, 2), slice(1 - half, None, 2)
        ranking = minimise_risk(p[seen], u[seen], 0.5, steps=600)
        for own, x in zip(ranks, (p, u)):
            own[other] = x[other] @ ranking
    prior = estimate_prior(*ranks)
    return Model(mean, scale, minimise_risk(p, u, prior), prior)


def samples(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``doc_id, text, trusted``: up to ``rows`` trusted positives and as many unlabelled documents, of other ids.

    A hash of the id deals documents to two halves. The positives of one are
    trusted; of the other all documents are unlabelled, whatever labels they
    have, so they hold good texts in the share in which all documents do. Where
    there are more, those with the smallest hashes are taken.
    """
    half = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2))
    known = F.col("doc_id").isNotNull() & ~held_out()
    chosen = lambda ids, trusted: (ids.where(known & (half == int(trusted))).distinct()
                                   .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("trusted", F.lit(trusted)))
    ids = lambda table: table.select(F.col("doc_id").cast("long").alias("doc_id"))
    both = chosen(ids(labels.where("quality = 1")), True).unionByName(chosen(ids(docs), False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Twice ``rows`` ids at most, so the texts need not move.
    return texts.join(F.broadcast(both), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS // 2) -> Model:
    """A model from ``rows`` trusted positives and ``rows`` unlabelled documents at most, none of them held out.

    No label but 1 is ever read. With fewer than ten positives or unlabelled
    documents every text gets the score 0.5.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "trusted", "x"])

    # Some 26 numbers for each document of the bounded samples; sorted, so that sums come out alike in every run.
    seen = samples(docs, labels, rows).select("doc_id", "text", "trusted").mapInArrow(measure, "doc_id long, trusted boolean, x array<double>")
    seen = sorted(durable(seen).collect(), key=lambda r: (r.doc_id, r.x))
    p, u = (np.array([r.x for r in seen if r.trusted == t]).reshape(-1, len(NAMES)) for t in (True, False))
    if min(len(p), len(u)) < 10:
        n = len(NAMES)
        return Model(np.zeros(n), np.ones(n), np.zeros(2 * n + 1), 0.5)
    return fit_features(p, u)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text, in one pass without a shuffle.

    ``score`` is the chance that the text is good. Null texts count as empty
    ones, whose features are all 0. Equal texts score alike, null ids stay
    null, an empty table gives no rows, and other columns are not read.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double")
