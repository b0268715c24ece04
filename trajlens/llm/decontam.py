"""Benchmark decontamination by CGK embedding, bit sampling and exact edit distance.

Texts and items are sequences of words. A window of an item's size goes on a
random walk over its words: at each step the word's bit for that step decides
whether the walk moves on. Two sequences that differ by few edits fall back
into step, so their walks differ in few places. Samples of the places are keys;
a window that shares a key with an item is aligned with it exactly.

A count of words is taken first: a window cannot be within d edits of an item
of n words unless n - d of its words are words of the benchmark. That drops
windows without losing a match.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of items one pass over the documents looks for; more items take more passes.
PASS_WORDS = 2_000_000
#: Words of documents a task works on at a time.
CHUNK_WORDS = 1_000_000
#: The same where the documents' other columns wait for the decision.
KEPT_WORDS = 200_000
#: Windows embedded at a time.
WINDOWS = 50_000
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """``edits``: edits allowed, as a share of an item's words. ``walks`` embeddings with ``samples`` keys of ``places`` each."""

    edits: float = 0.2
    min_words: int = 8
    walks: int = 12
    samples: int = 8
    places: int = 3
    seed: int = 20


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, in lower case."""
    return text.lower().encode().translate(_TO_WORDS).split()


class Index:
    """The items of one pass: their words, and their keys for each length, walk and sample."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        self.settings = settings
        split = [(i, words_of(t)) for i, t in items]
        split = sorted((i, w) for i, w in split if len(w) >= settings.min_words)
        self.vocabulary: dict[bytes, int] = {}
        for _, ws in split:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.ids = [i for i, _ in split]
        self.sequences = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for _, ws in split]
        self.longest = max(map(len, self.sequences), default=0)
        self.by_length: dict[int, list[int]] = {}
        for k, s in enumerate(self.sequences):
            self.by_length.setdefault(len(s), []).append(k)
        self.different = np.array([len(np.unique(s)) for s in self.sequences], dtype=np.int64)
        self.walks = {n: self._learn(n, members) for n, members in self.by_length.items()}
        members = [np.unique(s) + (k << 32) for k, s in enumerate(self.sequences)]
        self.members = np.sort(np.concatenate(members)) if members else np.empty(0, np.int64)

    @staticmethod
    def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def edits(self, n: int) -> int:
        return int(self.settings.edits * n)

    def _walks(self, n: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Where each walk over windows of ``n`` words begins, its bits' factors and the places of its samples.

        A walk begins at any word of the window, and its first place is that
        word, so that windows in which it is no item's word need not walk.
        """
        s = self.settings
        for walk in range(s.walks):
            random = np.random.default_rng([s.seed, n, walk])
            begin = int(random.integers(0, max(1, n - s.places))) if walk else 0
            steps = max(s.places, 2 * (n - begin))
            factors = random.integers(1, 2 ** 62, steps) * 2 + 1
            # Near places are likelier to be in step, far ones to tell items apart.
            reach = [max(s.places, steps // f) for f in (8, 4, 2, 1)]
            places = [np.sort(random.choice(np.arange(1, reach[k % 4]), s.places - 1, replace=reach[k % 4] <= s.places - 1)) for k in range(s.samples)]
            yield begin, factors, places

    @staticmethod
    def _keys(windows: np.ndarray, begin: int, factors: np.ndarray, places: list[np.ndarray]) -> Iterator[np.ndarray]:
        """A key of each window for each sample of one walk."""
        rows, n = windows.shape
        flat, base = np.c_[windows, np.full(rows, -1)].ravel(), np.arange(rows) * (n + 1)
        wanted = {int(j) for p in places for j in p}
        at, seen, first = np.full(rows, begin), {}, windows[:, begin]
        for j in range(max(wanted) + 1):
            word = flat[base + at]
            if j in wanted:
                seen[j] = word
            at = np.minimum(at + ((word + 7) * factors[j] >> 40 & 1), n)
        for p in places:
            key = first.copy()
            for j in p.tolist():
                key = (key ^ seen[j]) * 0x5851F42D4C957F2D + j
                key ^= key >> 29
            yield key

    def _learn(self, n: int, members: list[int]) -> list[tuple]:
        """The walks over windows of ``n`` words, which words can begin each, and its items' sorted keys."""
        windows, out = np.stack([self.sequences[m] for m in members]), []
        for begin, factors, places in self._walks(n):
            begins = np.zeros(len(self.vocabulary) + 1, dtype=bool)
            begins[windows[:, begin]] = True
            out.append((begin, factors, places, begins, [self._sorted(k) for k in self._keys(windows, begin, factors, places)]))
        return out

    def candidates(self, text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length, starts of windows and the numbers of the items they share a key with."""
        known = np.r_[0, np.cumsum(text > 0, dtype=np.int32)]
        for n, members in self.by_length.items():
            if len(text) < n:
                continue
            need = n - self.edits(n)
            starts = np.flatnonzero(known[n:] - known[:-n] >= need)
            view, numbers = np.lib.stride_tricks.sliding_window_view(text, n), np.array(members)
            pairs = [np.empty(0, np.int64)]
            for begin, factors, places, begins, own in self.walks[n]:
                alive = starts[begins[text[starts + begin]]]
                for at in range(0, len(alive), WINDOWS):
                    some = alive[at:at + WINDOWS]
                    for keys, (sorted_keys, order) in zip(self._keys(view[some], begin, factors, places), own):
                        lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
                        for extra in range(int((hi - lo).max(initial=0))):
                            rows = np.flatnonzero(hi - lo > extra)
                            pairs.append(some[rows] * len(members) + order[lo[rows] + extra])
            found = np.unique(np.concatenate(pairs))
            for at in range(0, len(found), WINDOWS):
                start, item = found[at:at + WINDOWS] // len(members), numbers[found[at:at + WINDOWS] % len(members)]
                # Each edit takes away one different word of the item at most.
                words = np.sort(view[start], axis=1)
                code = words + (item[:, None] << 32)
                place = np.minimum(np.searchsorted(self.members, code), len(self.members) - 1)
                held = self.members[place] == code
                held[:, 1:] &= words[:, 1:] != words[:, :-1]
                enough = held.sum(1) >= self.different[item] - self.edits(n)
                if enough.any():
                    yield n, start[enough], item[enough]

    def verified(self, text: np.ndarray, n: int, starts: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edit distance of each item to any run of words in reach of the window, and where the run ends."""
        d = self.edits(n)
        reach = n + 3 * d
        padded = np.r_[np.zeros(d, np.int64), text, np.zeros(reach, np.int64)]
        runs = np.lib.stride_tricks.sliding_window_view(padded, reach)[starts]
        wanted = np.stack([self.sequences[i] for i in items])
        j = np.arange(reach + 1)
        row = np.zeros((len(starts), reach + 1), dtype=np.int64)   # an item may start anywhere in the run
        for i in range(n):
            new = row + 1
            new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (runs != wanted[:, i:i + 1]))
            row = np.minimum.accumulate(new - j, axis=1) + j
        return row.min(1), starts - d + row.argmin(1)

    def matches(self, texts: list[list[bytes]]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text, its items with ``(edits, last word, places)``, places being runs that end at different words."""
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        if not self.ids:
            return out
        gap = np.zeros(self.longest, dtype=np.int64)   # no window reaches into the next text
        coded = [np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.int64, len(ws)) for ws in texts]
        begin = np.cumsum([0, *(len(c) + len(gap) for c in coded)])
        text = np.concatenate([x for c in coded for x in (c, gap)])
        ends: dict[tuple[int, int], set[int]] = {}
        for n, starts, items in self.candidates(text):
            for at in range(0, len(starts), 20_000):
                part = slice(at, at + 20_000)
                edits, end = self.verified(text, n, starts[part], items[part])
                for k in np.flatnonzero(edits <= self.edits(n)).tolist():
                    doc = int(np.searchsorted(begin, starts[at + k], "right")) - 1
                    item, last = int(items[at + k]), int(end[k] - begin[doc] - 1)
                    ends.setdefault((doc, item), set()).add(last)
                    best = out[doc].get(self.ids[item])
                    if best is None or (int(edits[k]), last) < best[:2]:
                        out[doc][self.ids[item]] = (int(edits[k]), last, 0)
        for (doc, item), found in ends.items():
            e, last, _ = out[doc][self.ids[item]]
            out[doc][self.ids[item]] = (e, last, len(found))
        return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("item_words", pa.int64()),
                     ("last_word", pa.int64()), ("places", pa.int64())])
_DDL = "doc_id long, item_id long, edits long, item_words long, last_word long, places long"


def passes(items: DataFrame, settings: Settings) -> Iterator[Index]:
    """The items in passes of at most some PASS_WORDS words; one of no items where there are none."""
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = wanted.where("item_id IS NOT NULL").distinct()
    # Runs of word characters and what lies between them bound the number of words.
    size = F.length(F.regexp_replace("text", "[A-Za-z0-9\\x{80}-\\x{10ffff}]+", "x"))
    number = 1 + int((wanted.agg(F.sum(size)).first()[0] or 0) // PASS_WORDS)
    for k in range(number):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).collect()
        yield Index([(r.item_id, r.text) for r in rows], settings)


def _slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Runs of a batch's rows with their words, of about ``size`` words each."""
    begin, texts, held = 0, [], 0
    for row, text in enumerate(batch.column(column)):
        texts.append(words_of(text.as_py() or ""))
        held += len(texts[-1])
        if held >= size or row == batch.num_rows - 1:
            yield batch.slice(begin, row + 1 - begin), texts
            begin, texts, held = row + 1, [], 0


def find_leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold an item up to the allowed edits: one row per document and item.

    ``edits`` is the least word-level edit distance of the item to a run of
    the document's words, ``last_word`` the word that run ends at, ``places``
    the number of different ends found. Null texts are empty; null and repeated
    items count once each by id and text; items of fewer than ``min_words``
    words are no evidence and match nothing. Repeated documents give repeated
    rows, null ids stay null, empty tables give no rows, and other columns are
    not read. Items go to the tasks in passes of at most PASS_WORDS words, so
    what a task holds is bounded, however large the benchmark is. Where ids
    repeat with other texts, each text is an item, and its id's last one wins.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    result = None
    for index in passes(items, settings):
        def look(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            lengths = {i: len(s) for i, s in zip(index.ids, index.sequences)}
            for batch in batches:
                for rows, texts in _slices(batch, 1, CHUNK_WORDS):
                    found = [(d, i, e, lengths[i], last, places) for d, m in zip(rows.column(0).to_pylist(), index.matches(texts))
                             for i, (e, last, places) in sorted(m.items())]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _SCHEMA)], schema=_SCHEMA)

        found = chosen.mapInArrow(look, _DDL)
        result = found if result is None else result.unionByName(found)
    return result


def without_leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item; null and empty texts hold none.

    Repeated rows all go or all stay, null ids take part like any others, an empty
    table or benchmark takes nothing away. One pass for each pass of items,
    without a shuffle; only texts go to Python, and only the decisions come back.
    """
    def without(index: Index):
        @F.arrow_udf("boolean")
        def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in columns:
                out: list[bool] = []
                for _, words in _slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0, KEPT_WORDS):
                    out += [not m for m in index.matches(words)]
                pa.default_memory_pool().release_unused()
                yield pa.array(out, pa.bool_())

        return clean

    for index in passes(items, settings):
        docs = docs.where(without(index)(F.col(text_col).cast("string")))
    return docs
