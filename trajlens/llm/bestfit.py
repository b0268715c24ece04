"""Best-fit packing in bulk-synchronous supersteps.

Documents of one length are a run with a count, sequences with the same gap
that were filled by the same step are another; what sweeps and moves are runs,
whose number is bounded by the capacity and not by the documents. A document is
its place in its run: a task numbers the documents of each length it reads, and
the counts of the tasks before it are added.

A superstep takes the documents longer than half of the longest one left, and
the gaps that can hold them. Both are sorted by size and cut into ranges. A
range is swept from its longest documents down: a run goes to its successor, the
smallest gap that holds it, as often as it fits; where documents and gaps of two
runs meet, the k-th document takes the k-th place. Gaps shrink and go on to
later documents. What found no gap in its range meets the wider ranges of the
next superstep, and in the last one, of a single range, opens new sequences.

The steps leave rules of the form "documents of this length from this rank on
go to the sequences from this number on". A join turns them into places.
"""

import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlens.llm.wordpieces import runs_of, word_ids
from trajlens.session import durable

#: Runs that one task sweeps, about.
SWEEP_ROWS = 200_000
#: Rules that are sent to all tasks; with more, Spark joins them.
BROADCAST_RULES = 200_000

_DOCS, _GAPS, _RULES = 0, 1, 2
_RUN = "kind int, size long, first long, count long, copies long, bin long, offset long"
_RUN_TYPES = [("kind", pa.int32()), ("size", pa.int64()), ("first", pa.int64()), ("count", pa.int64()), ("copies", pa.int64()),
              ("bin", pa.int64()), ("offset", pa.int64())]


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, open_from: int | None = None):
    """One sweep over runs ``(size, first, count)``, of documents by rank and of gaps by sequence.

    Returns the rules ``(length, rank, documents, copies, sequence, offset)`` by which
    ``copies`` documents after each other go to each sequence, and the runs of
    documents and gaps that are left. With ``open_from`` documents without a
    gap open sequences of that number on, so none are left.
    """
    gaps, rules, left = sorted(gaps), [], []
    for size, first, count in sorted(docs, reverse=True):
        at = bisect_left(gaps, (size,))
        while count:
            if at < len(gaps):
                gap, sequence, many = gaps.pop(at)
            elif open_from is not None:
                gap, sequence, many = capacity, open_from, -(-count // (capacity // size))
                open_from += many
            else:
                left.append((size, first, count))
                break
            copies = gap // size
            filled = min(many, count // copies)
            if filled == 0:        # fewer documents than one gap holds
                copies, filled = count, 1
            rules.append((size, first, filled * copies, copies, sequence, capacity - gap))
            if gap > copies * size:
                insort(gaps, (gap - copies * size, sequence, filled))
            if many > filled:
                insort(gaps, (gap, sequence + filled, many - filled))
            first, count = first + filled * copies, count - filled * copies
            at = bisect_left(gaps, (size,))
    return rules, left, gaps


def _swept(rows: pa.Table, capacity: int, open_from: int | None) -> pa.Table:
    of = {k: [] for k in (_DOCS, _GAPS)}
    for kind, *run in zip(*(rows.column(c).to_pylist() for c in ("kind", "size", "first", "count"))):
        of[kind].append(tuple(run))
    rules, docs, gaps = sweep(of[_DOCS], of[_GAPS], capacity, open_from)
    out = [(_RULES, *r) for r in rules] + [(_DOCS, *d, 0, 0, 0) for d in docs] + [(_GAPS, *g, 0, 0, 0) for g in gaps]
    columns = zip(*out) if out else [[]] * len(_RUN_TYPES)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, _RUN_TYPES)], names=[n for n, _ in _RUN_TYPES])


def _superstep(runs: DataFrame, ranges: int, capacity: int, open_from: int | None) -> DataFrame:
    if ranges == 1:
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = list(batches)
            if got:
                yield from _swept(pa.Table.from_batches(got), capacity, open_from).to_batches()

        return runs.coalesce(1).mapInArrow(whole, _RUN)

    def one(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _swept(rows, capacity, None)

    # Ranges of about as many runs, by size; runs of one size share a range.
    order = Window.orderBy("share")
    shares = runs.groupBy(F.floor(F.col("size") * (8 * ranges) / (capacity + 1)).alias("share")).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())
    cut = shares.select("share", F.floor((F.sum("rows").over(order) - 1) * ranges / total).alias("range"))
    dealt = runs.withColumn("share", F.floor(F.col("size") * (8 * ranges) / (capacity + 1))).join(cut, "share").drop("share")
    return dealt.groupBy("range").applyInArrow(one, _RUN)


def packing_rules(lengths: DataFrame, capacity: int) -> DataFrame:
    """``length, rank, documents, copies, bin, offset`` of all supersteps, from ``length, many``: how often each length below the capacity occurs."""
    nothing = [F.lit(0).cast("long").alias(c) for c in ("copies", "bin", "offset")]
    state = durable(lengths.select(F.lit(_DOCS).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"),
                                   F.col("many").alias("count"), *nothing).coalesce(1))
    rules, opened = [], 0
    longest = state.agg(F.max("size")).first()[0]
    while longest:
        active = state.where(F.col("size") > longest // 2)
        ranges = max(1, -(-active.count() // SWEEP_ROWS))
        while True:
            moved = durable(_superstep(active, ranges, capacity, opened if ranges == 1 else None))
            rules.append(moved.where(F.col("kind") == _RULES))
            active = moved.where(F.col("kind") != _RULES)
            if ranges == 1:
                break
            ranges = -(-ranges // 4)
        state = durable(state.where(F.col("size") <= longest // 2).union(active).coalesce(1))
        opened = max(opened, rules[-1].agg(F.max(F.col("bin") + F.ceil(F.col("count") / F.col("copies")))).first()[0] or 0)
        longest = state.where(F.col("kind") == _DOCS).agg(F.max("size")).first()[0]
    found = reduce(DataFrame.union, rules) if rules else state.where("false")
    return found.select(F.col("size").alias("length"), F.col("first").alias("rank"), F.col("count").alias("documents"), "copies", "bin", "offset")


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long"
_PIECE_TYPES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                ("task", pa.int64()), ("place", pa.int64())]


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document; ``place`` counts those of one length in one task."""
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, places = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for some in runs_of(batch, 1):
                rows = []
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc_id, ids in zip(some.column(0).to_pylist(), word_ids(tokenizer, texts)):
                    ids = memoryview(ids + end)
                    for piece, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[begin:begin + 4 * capacity]
                        length = len(part) // 4
                        rows.append((doc_id, piece, begin // 4, length, zlib.crc32(part), task, places[length]))
                        places[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PIECE_TYPES)], [n for n, _ in _PIECE_TYPES])

    return docs.mapInArrow(encode, _PIECE)


def pack_best_fit(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece, in few sequences of at most ``capacity`` tokens.

    A document is its ids followed by ``end_id``; a null or empty text is the
    single ``end_id``. Only documents longer than ``capacity`` are cut, into
    pieces of that length and a rest. Equal rows are packed like any others and
    so are rows of one id, null ids stay null, ties in length are broken by
    where a row was read, an empty table gives no rows, and other columns are
    not read. ``offset`` counts from 0 in a sequence without gaps.
    """
    if capacity < 1:
        raise ValueError("capacity has to be at least 1")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = durable(_pieces(chosen, tokenizer, end_id, capacity))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*keep, (F.lit(1 << 62) + F.shiftleft("task", 32) + F.col("place")).alias("sequence_id"),
                                                            F.lit(0).cast("long").alias("offset"))
    parts = pieces.where(F.col("length") < capacity)
    counts = durable(parts.groupBy("length", "task").agg(F.count(F.lit(1)).alias("many")))
    rules = packing_rules(counts.groupBy("length").agg(F.sum("many").alias("many")), capacity)
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("length", "task", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("earlier"))
    number = F.col("earlier") + F.col("place") - F.col("rank")
    placed = parts.join(ranks, ["length", "task"]).join(rules, "length").where((number >= 0) & (number < F.col("documents")))
    return full.unionByName(placed.select(*keep, (F.col("bin") + F.floor(number / F.col("copies"))).alias("sequence_id"),
                                          (F.col("offset") + number % F.col("copies") * F.col("length")).alias("offset")))
