"""Vector bin packing of token sequences: the dot-product heuristic under several limits at once.

A sequence has three limits: tokens, segments (pieces of documents) and
loss-bearing tokens. The piece put next is, of those in a bounded pool that
still fit, the one whose demand has the largest dot product with what the
sequence has left, both as shares of the limits. Where none fits, a document
may be cut at the sequence's end and the rest goes back to the pool.

Each task packs the documents it reads, so nothing is shuffled. The one
unfinished sequence each task leaves is packed again with those of the tasks
next to it.
"""

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.wordpieces import runs_of, word_ids
from trajlens.session import durable

#: Pieces a task chooses from.
POOL = 256
#: Tasks whose unfinished sequences are packed together.
TAILS = 32


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


@dataclass
class Piece:
    """A run of one document's ids, little-endian unsigned 32-bit; ids from ``loss_from`` on bear loss."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int
    loss_from: int = 0

    def __len__(self) -> int:
        return len(self.ids) // 4

    def loss(self) -> int:
        return min(len(self), max(0, self.start + len(self) - self.loss_from))

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.doc_id, self.start, self.ids[:4 * n], self.doc_tokens, self.loss_from),
                Piece(self.doc_id, self.start + n, self.ids[4 * n:], self.doc_tokens, self.loss_from))


def sequences(pieces: Iterable[Piece], limits: Limits, cut: bool = True) -> Iterator[tuple[list[Piece], bool]]:
    """The packed sequences in turn, each with whether it was closed for lack of further pieces.

    Without ``cut`` only a piece that is too large for an empty sequence is cut.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
    if cap.min() < 1:
        raise ValueError("every limit has to be at least 1")
    source = iter(pieces)
    pool: list[Piece | None] = [None] * POOL
    need = np.zeros((POOL, 3))
    free, more = list(range(POOL)), True

    def put(at: int, piece: Piece) -> None:
        pool[at] = piece
        need[at] = (len(piece), 1, piece.loss())

    def refill() -> None:
        nonlocal more
        while free and more:
            piece = next(source, None)
            if piece is None:
                more = False
            elif len(piece):
                put(free.pop(), piece)

    while True:
        left, chosen = cap.copy(), []
        while True:
            refill()
            filled = need[:, 1] > 0
            if not filled.any():
                if chosen:
                    yield chosen, True
                return
            fits = filled & (need <= left).all(axis=1)
            score = (need / cap) @ (left / cap)
            if fits.any():
                at = int(np.argmax(np.where(fits, score, -1.0)))
                piece = pool[at]
                chosen.append(piece)
                left -= need[at]
                pool[at], need[at] = None, 0
                free.append(at)
            elif left[0] >= 1 and left[1] >= 1 and (cut or not chosen):
                at = int(np.argmax(np.where(filled, score, -1.0)))
                piece = pool[at]
                bare = max(0, piece.loss_from - piece.start)
                n = int(min(left[0], bare + left[2], len(piece) - 1))
                if n < 1:
                    break
                head, rest = piece.cut(n)
                chosen.append(head)
                left -= (n, 1, head.loss())
                put(at, rest)
            else:
                break
        yield chosen, False


def _closed(chosen: list[Piece]) -> bool:
    n = sum(map(len, chosen))
    return n & (n - 1) == 0


_COLUMNS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
            ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()),
            ("task", pa.int64()), ("loss_from", pa.int64()), ("tail_ids", pa.binary())]
_SCHEMA = pa.schema(_COLUMNS)
_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "loss_tokens long, task long, loss_from long, tail_ids binary")


def _rows(packed, first: int, task: int, tails: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for number, (chosen, last) in enumerate(packed):
        keep, offset = tails and last and not _closed(chosen), 0
        for p in chosen:
            rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, first + number, offset, p.loss(), task,
                         p.loss_from, p.ids if keep else None))
            offset += len(p)
        if len(rows) >= 4096:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _COLUMNS)], schema=_SCHEMA)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), cut: bool = True,
         id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None) -> DataFrame:
    """One row per piece: where the document's ids lie in which sequence.

    A document is its ids followed by ``end_id``. A null or empty text is the
    single ``end_id``. Equal rows are packed like any others, null ids stay
    null, an empty table gives no rows, and other columns are not read.
    ``loss_from_col`` names the number of leading ids that bear no loss (null:
    0), as for the prompt of an instruction. Pieces of one document may lie in
    several sequences; together they hold each id once. ``sequence_id`` is
    unique over the result, ``offset`` counts from 0 in a sequence.
    """
    end = struct.pack("<I", end_id)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def pieces() -> Iterator[Piece]:
            for batch in batches:
                for some in runs_of(batch, 1):
                    texts = [t or "" for t in some.column(1).to_pylist()]
                    for doc_id, skip, ids in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), word_ids(tokenizer, texts)):
                        ids += end
                        yield Piece(doc_id, 0, ids, len(ids) // 4, max(0, skip))

        yield from _rows(sequences(pieces(), limits, cut), task << 32, task, True)

    def again(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pieces = (Piece(d, s, i, n, f) for d, s, i, n, f in zip(*(rows.column(c).to_pylist() for c in (
            "doc_id", "start", "tail_ids", "doc_tokens", "loss_from"))))
        group = key[0].as_py()
        batches = list(_rows(sequences(pieces, limits, cut), 1 << 62 | group << 32, group, False))
        return pa.Table.from_batches(batches, _SCHEMA)

    skip = F.coalesce(F.col(loss_from_col).cast("long"), F.lit(0).cast("long")) if loss_from_col else F.lit(0).cast("long")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), skip.alias("skip"))
    # Written once: both the finished and the unfinished sequences are read from it.
    written = durable(chosen.mapInArrow(first, _DDL))
    tails = written.where("tail_ids IS NOT NULL").groupBy(F.floor(F.col("task") / TAILS).alias("tasks")).applyInArrow(again, _DDL)
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    return written.where("tail_ids IS NULL").select(*keep).unionByName(tails.select(*keep))
