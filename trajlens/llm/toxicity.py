"""Toxic passages by maximum-scoring segments over token log-odds.

Each word gets the log-odds of its best form (the word or a leading part of
it) between toxic and other documents, with an informative Dirichlet prior;
forms that are not significant score as ordinary words, slightly below zero.
One linear scan finds all maximal segments of a text. Under random text their
scores follow an extreme-value law; a segment's evidence is how far its score
exceeds what a text of that length gives by chance.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import worker_memory
from trajlens.llm.fitting import FIT_ROWS, labelled_sample, logistic, sigmoid
from trajlens.session import durable

_WORD = re.compile(r"\w+")
#: Lengths of the leading parts of a word that count as its forms.
PREFIXES = (4, 5, 6, 7)
#: Words a worker remembers the score of.
MEMO_WORDS = 250_000
#: Texts whose forms a task counts before it hands them on.
COUNTED_TEXTS = 200
#: Highest score of one word, so that a single word never decides.
TOP = 6.0


def forms(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if n <= len(word))]


@dataclass
class Model:
    """Scores of significant forms, of ordinary words, the extreme-value law and the calibration."""

    lexicon: dict[str, float] = field(default_factory=dict)
    ordinary: float = -0.02
    decay: float = 1.0        # lambda of the extreme-value law
    scale: float = 1.0        # K of the extreme-value law
    weights: list[float] = field(default_factory=lambda: [0.0] * 4)
    level: float = 0.05       # expected chance segments below which a segment is significant

    def word(self, w: str) -> float:
        return max((self.lexicon[f] for f in forms(w) if f in self.lexicon), default=0.0)


def segments(at: list[int], score: list[float], ordinary: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first word, last word, score)`` of a text, in one pass.

    ``at`` and ``score`` give the words with a positive score; every other word
    scores ``ordinary``, which is negative, so that segments start and end at
    positive words. Each new word opens a segment, which joins those before it
    while that raises the score; every join removes one from the list.
    """
    found: list[list] = []   # first, last, sum before it, sum with it
    total, before = 0.0, -1
    for i, s in zip(at, score):
        total += ordinary * (i - before - 1)
        left = total
        total += s
        before = i
        new = [i, i, left, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new.append(j)
                found.append(new)
                break
            new = [found[j][0], i, found[j][2], total]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def _features(n: int, found: list[tuple[int, int, float]], hits: int, model: Model) -> tuple[list[float], list[float]]:
    """What the calibration takes, and the evidence of each segment (minus the log of its expected number)."""
    evidence = [model.decay * s - log(max(model.scale * max(n, 1), 1e-300)) for _, _, s in found]
    significant = [e for e in evidence if e >= -log(model.level)]
    best = max(evidence, default=min(0.0, -log(max(model.scale * max(n, 1), 1e-300))))
    return [float(np.clip(best, -10, 30)) / 5, log1p(sum(significant)), hits / (n + 20.0) * 20], evidence


class _Scorer:
    def __init__(self, model: Model):
        self.model = model
        memory = worker_memory("toxic words")
        if memory.get("model") != model.lexicon:
            memory.clear()
            memory |= {"model": dict(model.lexicon), "words": {}}
        self.words: dict[str, float] = memory["words"]

    def hits(self, text: str) -> tuple[int, list[int], list[float]]:
        words, known = _WORD.findall(text.lower()), self.words
        new = set(words).difference(known)
        if new:
            if len(known) > MEMO_WORDS:
                known.clear()
                new = set(words)
            known.update((w, self.model.word(w)) for w in new)
        scores = list(map(known.__getitem__, words))
        if not any(scores):
            return len(words), [], []
        at = [i for i, s in enumerate(scores) if s]
        return len(words), at, [scores[i] for i in at]

    def document(self, text: str) -> tuple[list[float], list[dict]]:
        n, at, scores = self.hits(text)
        found = segments(at, scores, self.model.ordinary)
        features, evidence = _features(n, found, len(at), self.model)
        spans: list[dict] = []
        if any(e >= -log(self.model.level) for e in evidence):
            place = [m.span() for m in _WORD.finditer(text)] if len(text) == len(text.lower()) else None
            for (a, b, s), e in zip(found, evidence):
                if e >= -log(self.model.level):
                    start, stop = (place[a][0], place[b][1]) if place and b < len(place) else (None, None)
                    spans.append({"first_word": a, "last_word": b, "start": start, "stop": stop, "score": s, "evidence": e})
        return features, spans


def _lambda(chances: list[tuple[float, float]]) -> float:
    """The positive root of sum(p * exp(x * s)) = 1 for scores s of chance p, with a negative mean."""
    value = lambda x: sum(p * exp(min(700.0, x * s)) for s, p in chances) - 1
    high = 1e-3
    while value(high) < 0 and high < 50:
        high *= 2
    low = high / 2 if value(high / 2) < 0 else 0.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, prior: float = 500.0, z: float = 3.2, least: int = 3) -> Model:
    """A model from labelled documents, of which at most ``rows`` are used; held-out documents never are.

    The Dirichlet prior gives each form a half and its share of ``prior``; ``z`` is the
    significance from which on a form is in the lexicon, ``least`` the number of
    toxic documents it has to occur in. Without a toxic or without another document
    every text gets the smoothed share of toxic ones.
    """
    # Holds the texts of at most ``rows`` documents.
    sample = durable(labelled_sample(docs, labels, "toxic", rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED_TEXTS):
                batch = whole.slice(at, COUNTED_TEXTS)
                toxic, clean = Counter(), Counter()
                for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    (toxic if label else clean).update({f for w in set(_WORD.findall(text.lower())) for f in forms(w)})
                names = list(toxic.keys() | clean.keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()),
                                                  pa.array([clean[f] for f in names], pa.int64())], ["form", "toxic", "clean"])

    counted = durable(sample.select("text", "label").mapInArrow(count, "form string, toxic long, clean long")
                      .groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    sums = counted.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    n = {r.label: r.n for r in sample.groupBy((F.col("label") > 0).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model()
    if not n.get(True) or not n.get(False) or not sums.t or not sums.c:
        share = (n.get(True, 0) + 0.5) / (sum(n.values()) + 1)
        model.weights = [0.0, 0.0, 0.0, log(share / (1 - share))]
        return model
    own = F.lit(0.5) + F.lit(prior) * (F.col("toxic") + F.col("clean")) / (sums.t + sums.c)
    a, b = F.col("toxic") + own, F.col("clean") + own
    odds = F.log(a / (sums.t + prior - a)) - F.log(b / (sums.c + prior - b))
    # Few of the sample's forms are significant; their number is bounded by the sample.
    lexicon = (counted.withColumn("odds", odds).where((F.col("odds") / F.sqrt(1 / a + 1 / b) >= z) & (F.col("toxic") >= least))
               .select("form", "odds").collect())
    model.lexicon = {r.form: min(TOP, r.odds) for r in lexicon}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            out: list[tuple] = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, at, scores = scorer.hits(text)
                out.append((bool(label), words, [float(x) for x in at], scores))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], ["label", "words", "at", "scores"]) if out else pa.RecordBatch.from_arrays(
                [pa.array([], pa.bool_()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64())), pa.array([], pa.list_(pa.float64()))],
                ["label", "words", "at", "scores"])

    # One row of a few numbers for each document of the bounded sample.
    seen = sample.select("text", "label").mapInArrow(measure, "label boolean, words long, at array<double>, scores array<double>").collect()
    words = {k: 1 + sum(r.words for r in seen if r.label == k) for k in (True, False)}
    hits = {k: Counter(round(s, 2) for r in seen if r.label == k for s in r.scores) for k in (True, False)}
    share = {k: (sum(hits[k].values()) + 0.5) / (words[k] + 1) for k in (True, False)}
    model.ordinary = min(-0.005, log((1 - min(share[True], 0.5)) / (1 - min(share[False], 0.4))))
    scores = set(hits[True]) | set(hits[False])
    chances = [(s, (hits[False][s] + 0.5 / max(len(scores), 1)) / (words[False] + 1)) for s in scores]
    chances.append((model.ordinary, 1 - sum(p for _, p in chances)))
    if sum(s * p for s, p in chances) >= 0:
        model.ordinary = -2 * sum(s * p for s, p in chances[:-1])
        chances[-1] = (model.ordinary, chances[-1][1])
    model.decay = _lambda(chances)
    found = [(r.label, r.words, segments([int(x) for x in r.at], list(r.scores), model.ordinary), len(r.at)) for r in seen]
    # K from the clean documents: the mean of exp(lambda * S) / n over their best segments.
    best = [(exp(-model.decay * max(s for *_, s in f)), n) for label, n, f, _ in found if not label and f]
    model.scale = max(1e-9, len(best) / max(1.0, sum(n * e for e, n in best) * 2)) if best else 1.0 / words[False]
    x = np.array([_features(n, f, h, model)[0] for _, n, f, h in found])
    model.weights = logistic(x, np.array([r[0] for r in found], dtype=float), ridge=0.1).tolist()
    return model


_SPAN = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
                   ("score", pa.float64()), ("evidence", pa.float64())])
DDL = ("doc_id long, score double, passages array<struct<first_word: long, last_word: long, start: long, stop: long, "
       "score: double, evidence: double>>")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, passages`` of every whole text, in one pass without a shuffle.

    ``score`` is the calibrated chance that the document is toxic; passages
    are its significant segments, by words and by code points (null where
    lower-casing changes a text's length). Null and empty texts get the score
    of a text without evidence. Equal texts score alike, null ids stay null, an
    empty table gives no rows, and other columns are not read.
    """
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, w = _Scorer(model), np.array(model.weights)
        for batch in batches:
            rows = [scorer.document(t or "") for t in batch.column(1).to_pylist()]
            p = sigmoid(np.array([[*x, 1.0] for x, _ in rows]) @ w) if rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array([s for _, s in rows], pa.list_(_SPAN))],
                                             ["doc_id", "score", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scored, DDL)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``.

    Null and empty texts score as texts without evidence. Repeated rows all go or
    all stay, null ids take part like any others, an empty table gives no rows.
    Only texts go to Python, and only the decisions come back.
    """
    @F.arrow_udf("boolean")
    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer, w = _Scorer(model), np.array(model.weights)
        for texts in columns:
            out = []
            for at in range(0, len(texts), COUNTED_TEXTS):
                x = [[*scorer.document(t or "")[0], 1.0] for t in texts.slice(at, COUNTED_TEXTS).to_pylist()]
                out.append(sigmoid(np.array(x) @ w) < threshold)
            pa.default_memory_pool().release_unused()
            yield pa.array(np.concatenate(out) if out else np.empty(0, bool))

    return docs.where(clean(F.col(text_col).cast("string")))
