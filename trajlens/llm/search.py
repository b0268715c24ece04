"""Exact top-k inner products: norm-sorted blocks, rotated partial sums and Cauchy-Schwarz bounds.

Vectors are dealt into blocks by the level of their length. A first pass takes
each query against the block of the longest vectors, which gives every query a
score to beat. A pair of blocks is formed only where a query's length times
the block's longest vector reaches that score. In a pair, vectors go by
descending length in the axes of the singular vectors: the leading axes' sum
plus the product of what is left of both lengths bounds the score, and only
vectors whose bound reaches the score to beat are multiplied out, in integers.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.session import durable

#: Vectors in a block of candidates, and queries in a block of queries.
BLOCK, QUERIES = 4096, 1024
#: Vectors multiplied at a time, so that the scores to beat rise early.
STEP = 512
#: Levels of length per doubling of its square.
LEVELS = 8
#: Groups of (dimension, level) up to which their counts are broadcast: 2.4 MB.
BROADCAST_GROUPS = 100_000

_FOUND = "query_id long, vec_id long, score long"
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integers(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds a null or non-finite component."""
    x = F.transform(embedding, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return F.when(fine, F.transform(x, lambda e: F.floor(e * scale).cast("long")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    array = column.combine_chunks()
    return np.asarray(array.flatten()).reshape(len(array), dim)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors of one dimension, by descending singular value.

    What reaches the driver is the dim x dim matrix of their products.
    """
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(batch.num_rows, dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    rows = (vectors.select("v").mapInArrow(products, "i int, row array<double>")
            .select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect())
    gram = np.zeros((dim, dim))
    for r in rows:
        gram[r.i, r.j] = r.x
    values, axes = np.linalg.eigh(gram)
    return axes[:, np.argsort(-values)]


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which of the rows are their query's k best, ties by smaller id; rows that repeat a query and an id count as one, the best of them."""
    order = np.lexsort((-score, vec, query))
    new = np.r_[True, (query[order][1:] != query[order][:-1]) | (vec[order][1:] != vec[order][:-1])][:len(order)]
    once = order[new]
    order = once[np.lexsort((vec[once], -score[once], query[once]))]
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


def block_search(q_ids: np.ndarray, q: np.ndarray, beat: np.ndarray, c_ids: np.ndarray, c: np.ndarray, axes: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of one block for each query among scores of at least ``beat``; ``beat`` rises as scores are found."""
    q_len, c_len = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.argsort(-c_len, kind="stable")
    c_ids, c, c_len = c_ids[order], c[order], c_len[order]
    lead = max(1, axes.shape[1] // 4)
    q_lead, c_lead = q @ axes[:, :lead], c @ axes[:, :lead]
    q_rest = np.sqrt(np.maximum(q_len ** 2 - (q_lead ** 2).sum(1), 0))
    c_rest = np.sqrt(np.maximum(c_len ** 2 - (c_lead ** 2).sum(1), 0))
    # Sums of integers below 2^53 are exact as floats; beyond, Python's integers are taken.
    exact = np.float64 if (q_len.max(initial=0) + 1) * (c_len.max(initial=0) + 1) < 2 ** 52 else object
    q_exact, c_exact = q.astype(exact), c.astype(exact)
    out_q, out_v, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    beat = beat.copy()
    for at in range(0, len(c), STEP):
        part = slice(at, at + STEP)
        slack = 1e-6 * (1 + q_len * c_len[at])
        alive = np.flatnonzero(q_len * c_len[at] + slack >= beat)
        if not len(alive):
            break   # all further vectors are shorter
        bound = q_lead[alive] @ c_lead[part].T + np.outer(q_rest[alive], c_rest[part]) + slack[alive, None]
        rows, cols = np.nonzero((bound >= beat[alive, None]) & (q_ids[alive, None] != c_ids[None, part]))
        if not len(rows):
            continue
        rows, cols = alive[rows], cols + at
        if exact is np.float64 and len(rows) > len(alive) * STEP // 8:
            score = (q_exact[alive] @ c_exact[part].T)[np.searchsorted(alive, rows), cols - at].astype(np.int64)
        else:
            score = np.concatenate([(q_exact[rows[i:i + 65536]] * c_exact[cols[i:i + 65536]]).sum(1).astype(np.int64)
                                    for i in range(0, len(rows), 65536)])
        keep = score >= beat[rows]
        all_q, all_v, all_s = np.r_[out_q[0], rows[keep]], np.r_[out_v[0], c_ids[cols[keep]]], np.r_[out_s[0], score[keep]]
        best = _best(all_q, all_v, all_s, k)
        out_q, out_v, out_s = [all_q[best]], [all_v[best]], [all_s[best]]
        full, first, n = np.unique(out_q[0], return_index=True, return_counts=True)
        last = first + n - 1
        full, last = full[n == k], last[n == k]
        beat[full] = np.maximum(beat[full], out_s[0][last])
    return q_ids[out_q[0]], out_v[0], out_s[0]


def top_k(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each query's k highest inner products: ``query_id, rank, vec_id, score``.

    ``query`` is a condition on ``vec_id``. Components become floor(scale * x).
    Rows whose id is null, or whose vector is null or holds a null or
    non-finite component, take no part. Vectors meet only vectors of their own
    length; an empty vector scores 0. Ties go to the smaller id. Rows that
    repeat an id count as one candidate, with its best score, and never for
    the query of that id. With fewer than k candidates all are given; an empty
    table gives no rows. Other columns are not read.
    """
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("v"))
    rows = (rows.where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("dim", F.size("v")).withColumn("square", square)
            .withColumn("level", F.floor(LEVELS * F.log2(F.col("square") + 1)).cast("int")))
    rows = durable(rows)
    # At most some 16,000 levels for each dimension, however many vectors.
    levels = durable(rows.groupBy("dim", "level").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max("square")).alias("longest"),
                                                      F.count(F.when(query, 1)).alias("n_queries")))
    groups = levels.count()
    small = F.broadcast if groups <= BROADCAST_GROUPS else lambda df: df
    dims = [r.dim for r in levels.where("n_queries > 0").select("dim").distinct().collect()]
    axes = {d: rotation(rows.where(F.col("dim") == d), d) for d in dims if d}

    cut = lambda n, size: F.pmod(F.xxhash64("vec_id"), F.ceil(n / size))
    blocks = rows.join(small(levels.select("dim", "level", "n")), ["dim", "level"]).withColumn("part", cut(F.col("n"), BLOCK))
    asked = levels.groupBy("dim").agg(F.sum("n_queries").alias("n_queries"))
    queries = (rows.where(query).select("vec_id", "v", "dim", "square").join(small(asked), "dim")
               .withColumn("q_block", cut(F.col("n_queries"), QUERIES)))
    # How many parts a level has follows from its count.
    parts = levels.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1)))
    q_blocks = asked.where("n_queries > 0").withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_queries") / QUERIES) - 1)))

    def search(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _SCHEMA.empty_table()
        dim = key[0].as_py()
        if dim == 0:
            q, c, turn = np.zeros((left.num_rows, 1), np.int64), np.zeros((right.num_rows, 1), np.int64), np.ones((1, 1))
        else:
            q, c, turn = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim), axes[dim]
        beat = np.asarray(left.column("beat").fill_null(float("-inf")).combine_chunks(), dtype=np.float64)
        found = block_search(np.asarray(left.column("vec_id").combine_chunks()), q, beat, np.asarray(right.column("vec_id").combine_chunks()), c, turn, k)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], schema=_SCHEMA)

    def search_pairs(asking: DataFrame, pairs: DataFrame) -> DataFrame:
        """Every pair of blocks is a group of a bounded number of rows."""
        keys = ["dim", "q_block", "level", "part"]
        # New names for the columns of one side: both come from the same table.
        own = [F.col(c).alias(c) for c in (*keys, "vec_id", "v", "beat")]
        left = asking.join(pairs, ["dim", "q_block"]).select(*own).groupBy(*keys)
        right = blocks.join(pairs, ["dim", "level", "part"]).select(*keys, "vec_id", "v").groupBy(*keys)
        return left.cogroup(right).applyInArrow(search, _FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = once.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id"))), 1, k).alias("best"))
        return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
            "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.order")).alias("score"))

    longest = levels.groupBy("dim").agg(F.max("level").alias("level")).withColumn("part", F.lit(0).cast("long"))
    first = ranked(search_pairs(queries.withColumn("beat", F.lit(None).cast("double")), q_blocks.join(longest, "dim")))
    to_beat = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("beat"))
    queries = durable(queries.join(to_beat.groupBy("vec_id").agg(F.max("beat").alias("beat")), "vec_id", "left"))
    # The shortest length that can still reach a score to beat, for any query of the block.
    need = F.when(F.col("beat").isNull() | (F.col("beat") <= 0), 0.0).otherwise(F.col("beat") / F.sqrt(F.greatest("square", F.lit(1e-9))))
    reach = queries.groupBy("dim", "q_block").agg(F.min(need).alias("need"))
    pairs = (reach.join(parts.select("dim", "level", "part", "longest"), "dim").where(F.col("longest") * (1 + 1e-9) >= F.col("need"))
             .select("dim", "q_block", "level", "part"))
    return ranked(search_pairs(queries, pairs))
