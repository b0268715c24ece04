"""Ranked lexical search: short lists term at a time, then document at a time with skipping over the long ones.

1. Texts become blocks of documents with a posting list for each wanted term:
   the documents that hold it and how often. Only terms of the queries are wanted;
   where these are too many to send to the tasks, Spark's join picks them.
2. Counts over all blocks give each term its weight.
3. A block meets all queries. For one query the short lists are summed into
   accumulators, term at a time; the sums are then one more iterator with a
   bound of its own. This iterator and the long lists are walked document at a
   time in runs of documents. Iterators whose bounds together stay below the
   score to beat bring no candidates: they are only looked up, and a candidate
   is dropped as soon as what is left cannot lift it.
4. A sample of the blocks goes first. The k-th best score in it is one that k
   documents reach, so it is where all other blocks start.

Blocks and what one of them keeps for a query are bounded; the best of all
blocks are ranked by Spark.
"""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlens.session import durable

#: A block ends with the document that reaches one of these.
BLOCK_DOCS, BLOCK_TERMS = 8192, 4_000_000
#: Different query terms that are sent to the tasks; with more, Spark joins them.
SHIPPED_TERMS = 500_000
#: Queries that meet a block in one group.
QUERIES_A_GROUP = 1024
#: Lists are short that hold up to this share of a block's documents.
SHORT = 1 / 32
#: Documents walked at a time.
RUN = 512
#: One block of this many goes first.
FIRST = 16

#: What is between terms becomes a space, A-Z become a-z.
_BETWEEN = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TO_TERMS = bytes(32 if c in _BETWEEN else c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_TERMS).split()


class _Block:
    """Documents of a block and the postings of the wanted terms; all terms where none are given."""

    def __init__(self, names: list[bytes] | None, codes: dict[bytes, int] | None):
        self.names, self.codes = ([], {}) if names is None else (names, codes)
        self.grows, self.ids, self.sizes = names is None, [], []
        self.code, self.doc, self.times, self.terms = [], [], [], 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        if self.grows:
            for t in set(terms).difference(self.codes):
                self.codes[t] = len(self.names)
                self.names.append(t)
        held = np.fromiter(map(self.codes.get, terms, repeat(-1)), np.int64, len(terms))
        code, times = np.unique(held[held >= 0], return_counts=True)
        self.code.append(code)
        self.times.append(times)
        self.doc.append(np.full(len(code), len(self.ids), np.int64))
        self.ids.append(doc_id)
        self.sizes.append(len(terms))
        self.terms += len(terms)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.terms >= BLOCK_TERMS

    def batch(self, number: int) -> pa.RecordBatch:
        """A row for each term, after one of the documents."""
        code, doc, times = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.code, self.doc, self.times))
        order = np.argsort(code, kind="stable")
        code, doc, times = code[order], doc[order].astype("<i4"), times[order].astype("<i4")
        cuts = np.flatnonzero(np.diff(code, prepend=-1, append=-1)) if len(code) else np.zeros(1, np.int64)
        parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        nothing = [None] * len(parts)
        return pa.RecordBatch.from_arrays([
            pa.array([number] * (len(parts) + 1), pa.int64()), pa.array([None, *(self.names[code[a]] for a, _ in parts)], pa.binary()),
            pa.array([len(self.ids), *(b - a for a, b in parts)], pa.int64()),
            pa.array([np.asarray(self.sizes, "<i8").tobytes(), *(doc[a:b].tobytes() for a, b in parts)], pa.binary()),
            pa.array([None, *(times[a:b].tobytes() for a, b in parts)], pa.binary()),
            pa.array([self.ids, *nothing], pa.list_(pa.int64())),
            pa.array([sum(n > 0 for n in self.sizes), *nothing], pa.int64()), pa.array([self.terms, *nothing], pa.int64())], _POSTED)


_POSTED = ["block", "term", "many", "places", "times", "ids", "n_docs", "n_terms"]
_POSTED_DDL = "block long, term binary, many long, places binary, times binary, ids array<long>, n_docs long, n_terms long"


def _postings(docs: DataFrame, wanted: list[bytes] | None) -> DataFrame:
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        codes = None if wanted is None else {t: k for k, t in enumerate(wanted)}
        block = _Block(wanted, codes)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, terms_of(text.as_py()))
                if block.full():
                    yield block.batch(number)
                    number, block = number + 1, _Block(wanted, codes)
        if block.ids:
            yield block.batch(number)

    return docs.mapInArrow(post, _POSTED_DDL)


def _summed(docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different documents in order, each with the sum of its scores."""
    if not len(docs):
        return docs, scores
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    return docs[first], np.add.reduceat(scores, first)


def hybrid_top(lists: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray, k: int, beat: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents of at least ``beat`` and above 0, by summed scores; ties go by ``order``.

    A list holds ascending document numbers and what its term adds to each.
    """
    size = len(order)
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: len(x[0]))
    short = [x for x in lists if len(x[0]) <= size * SHORT]
    iterators = lists[len(short):]
    if short:
        iterators.append(_summed(*(np.concatenate(c) for c in zip(*short))))
    iterators.sort(key=lambda x: int(x[1].max()))
    bounds = np.cumsum([int(x[1].max()) for x in iterators])
    best, scores, at = np.empty(0, np.int64), np.empty(0, np.int64), [0] * len(iterators)
    beat = max(beat, 1)
    for end in range(RUN, size + RUN, RUN):
        # Iterators before ``bring`` cannot make a document reach the score to beat.
        bring = int(np.searchsorted(bounds, beat))
        if bring == len(iterators):
            break
        parts = []
        for i in range(bring, len(iterators)):
            docs, add = iterators[i]
            to = at[i] + int(np.searchsorted(docs[at[i]:at[i] + RUN], end))
            parts.append((docs[at[i]:to], add[at[i]:to]))
            at[i] = to
        docs, total = _summed(*(np.concatenate(c) for c in zip(*parts)))
        for i in range(bring - 1, -1, -1):
            alive = total + bounds[i] >= beat
            docs, total = docs[alive], total[alive]
            if not len(docs):
                break
            own, add = iterators[i]
            place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            total = total + np.where(own[place] == docs, add[place], 0)
        reach = total >= beat
        if reach.any():
            best, scores = np.r_[best, docs[reach]], np.r_[scores, total[reach]]
            if len(best) > k:
                top = np.lexsort((order[best], -scores))[:k]
                best, scores = best[top], scores[top]
            if len(best) == k:
                beat = max(beat, int(scores.min()))
    return best, scores


_FOUND = "item long, doc_id long, score long"


def _ranked_blocks(rows: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """``item, doc_id, score``: the best of each (block, group of queries)."""
    def rank(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("weight", "items", "beats", "places", "times", "ids")}
        head = next(r for r, ids in enumerate(columns["ids"]) if ids is not None)
        ids, sizes = columns["ids"][head], np.frombuffer(columns["places"][head], "<i8")
        norm = np.array([50 + 50 * int(s) * n // total for s in sizes], np.int64)
        # Documents without an id stand last among equals.
        order = np.argsort(np.argsort(np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64), kind="stable"))
        queries: dict[int, list] = {}
        beats: dict[int, int] = {}
        for r, weight in enumerate(columns["weight"]):
            if r != head:
                docs = np.frombuffer(columns["places"][r], "<i4").astype(np.int64)
                times = np.frombuffer(columns["times"][r], "<i4").astype(np.int64)
                adds = weight * ((1_000_000_000 * times) // (1000 * times + 20 * norm[docs]))
                for item, beat in zip(columns["items"][r], columns["beats"][r]):
                    queries.setdefault(item, []).append((docs, adds))
                    beats[item] = beat
        items, found, scores = [], [], []
        for item, lists in queries.items():
            docs, score = hybrid_top(lists, order, k, beats[item])
            items += [item] * len(docs)
            found += [ids[d] for d in docs.tolist()]
            scores += score.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in (items, found, scores)], names=["item", "doc_id", "score"])

    return rows.groupBy("block", "group").applyInArrow(rank, _FOUND)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` documents with the highest scores above 0.

    Equal scores go by ascending ``doc_id``, documents without an id after all
    others. Every row of ``docs`` is a document, also where rows repeat or share
    an id, and takes a rank of its own; null and empty texts hold no term, count
    nowhere and are never found. Of items, rows that repeat an id and a text are
    one; each text under one id, or under none, gets ranks of its own. Items of
    no known term, and empty tables, give no rows. Other columns are not read.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(query_col).cast("string").alias("text")).distinct()
    queries = durable(asked.mapInArrow(split, "item_id long, terms array<binary>").withColumn("item", F.monotonically_increasing_id()))
    held = queries.select("item", F.explode("terms").alias("term"))
    terms = held.select("term").distinct()
    # Sent to every task, so only up to a stated number.
    few = terms.limit(SHIPPED_TERMS + 1).collect()
    posted = durable(_postings(chosen, sorted(bytes(r.term) for r in few) if len(few) <= SHIPPED_TERMS else None))
    heads = posted.where("term IS NULL")
    lists = posted.where("term IS NOT NULL")
    if len(few) > SHIPPED_TERMS:
        lists = durable(lists.join(terms, "term", "left_semi"))
    counts = heads.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    n, total = counts.n or 0, counts.total or 1
    known = lists.groupBy("term").agg(F.sum("many").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = durable(held.join(known.select("term", weight.alias("weight")).where("weight > 0"), "term"))
    groups = max(1, -(-queries.count() // QUERIES_A_GROUP))

    def met(blocks, beats: DataFrame | None) -> DataFrame:
        """What the blocks chosen hold for the queries, with the score each has to beat."""
        none = F.lit(0).cast("long")
        asked = weighted.withColumn("beat", none) if beats is None else weighted.join(beats, "item", "left").withColumn("beat", F.coalesce("beat", none))
        by_term = asked.groupBy("term", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("group")).agg(
            F.first("weight").alias("weight"), F.collect_list("item").alias("items"), F.collect_list("beat").alias("beats"))
        rows = lists.where(blocks).join(by_term, "term").select("block", "group", "weight", "items", "beats", "places", "times", F.lit(None).cast("array<long>").alias("ids"))
        head = heads.where(blocks).select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"),
                                          F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<long>").alias("items"),
                                          F.lit(None).cast("array<long>").alias("beats"), "places", "times", "ids")
        return _ranked_blocks(rows.unionByName(head), n, total, k)

    sampled = F.pmod(F.xxhash64("block"), F.lit(FIRST)) == 0
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = lambda found: found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    first = durable(best(met(sampled, None)))
    beats = first.where(F.col("rank") == k).select("item", F.col("score").alias("beat"))
    found = best(first.drop("rank").unionByName(met(~sampled, beats)))
    return found.join(queries.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
