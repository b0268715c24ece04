"""Near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every whole text becomes its shingle set, the set's digest and a MinHash
   signature. Equal sets are one node.
2. Nodes are posted under each (coordinate, value) pair. Pairs with one node
   are dropped. In each posting list the node whose values are the most common
   is the leader; nodes that share enough coordinates with a leader are
   confirmed against it. This joins large groups of copies by stars, without
   their pairs.
3. For what the stars leave apart, the search is complete. Two signatures that
   share at least MATCHES of SIZE coordinates share one of the SIZE - MATCHES + 1
   rarest of each, so only these are joined; the long lists behind them are
   looked up in the signatures. Lists are joined by component, so nodes already
   joined make no pairs.
4. Lists that hold many components (a passage many texts share) are not joined
   by coordinates at all. The nodes on them are searched by the rarest part of
   their full shingle sets, with the exact bounds on size and position.
5. Every candidate is confirmed on the full sets, in integers.

A pair at exactly the threshold shares at least MATCHES of SIZE coordinates
with all but about 6 in a million chance, and more surely above it.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from trajlens.llm.common import shared_folder
from trajlens.llm.shingles import MinHash, jaccard_at_least, set_digest, shingle_set
from trajlens.session import durable

PERCENT = 75
#: Coordinates of a signature, and how many two near-duplicates share at least.
SIZE, MATCHES = 64, 32
#: Components on a list from which on its nodes are searched by full sets instead.
LONG_LIST = 32
#: Comparisons with one hub in one run of rows.
HUB_ROWS = 64
#: Sets, and shingles in them, that a task holds of one block.
BLOCK_SETS, BLOCK_SHINGLES = 256, 2_000_000


def _signed(texts: DataFrame) -> DataFrame:
    """``doc_id, n, digest, signature`` of each row."""
    hasher = MinHash(SIZE)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, signatures = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                n.append(len(s))
                digests.append(set_digest(s) if len(s) else None)
                signatures.append(hasher.signature(s).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                                             ["doc_id", "n", "digest", "signature"])

    return texts.mapInArrow(sign, "doc_id long, n long, digest binary, signature binary")


def _postings(nodes: DataFrame) -> DataFrame:
    """``token, node``: a token is a coordinate and its value."""
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(SIZE, dtype=np.int64) << 32
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, SIZE).astype(np.int64) | place
            yield pa.RecordBatch.from_arrays([pa.array(values.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), SIZE))], ["token", "node"])

    return nodes.select("node", "signature").mapInArrow(post, "token long, node long")


def _similar_size(a: Column, b: Column) -> Column:
    return (a * 100 >= b * PERCENT) & (b * 100 >= a * PERCENT)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``): the smallest node each can reach.

    Labels go to neighbours and to the label's own node, and are followed once
    more in each round, so the rounds grow with the logarithm of a chain.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        hooked = own.groupBy(F.col("label").alias("node")).agg(F.min("new").alias("hook"))
        moved = own.join(hooked, "node", "left").select("node", "label", F.least("new", F.coalesce("hook", "new")).alias("new"))
        target = moved.select(F.col("node").alias("at"), F.col("new").alias("next"))
        jumped = durable(moved.join(target, F.col("new") == F.col("at"), "left").select("node", "label", F.least("new", F.coalesce("next", "new")).alias("new")))
        changed = not jumped.where("new < label").isEmpty()
        labels = jumped.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``a, b``) whose full sets are similar enough; ``a`` should be the node that many pairs share.

    The pairs of a hub go to several runs of rows, each led by the hub's text.
    A task holds the hub's set and one other.
    """
    pairs = durable(pairs.select("a", "b").distinct())
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("many"))
    runs = durable(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / HUB_ROWS)).alias("run")))
    wanted = runs.select(F.col("a").alias("hub"), "run", F.lit(0).alias("part"), F.col("a").alias("node")).distinct().union(
        runs.select("a", "run", F.lit(1), "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            found = []
            for hub, run, part, node, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                s = shingle_set(text.as_py())
                if part == 0:
                    at, own = (hub, run), s
                elif at == (hub, run) and jaccard_at_least(own, s, PERCENT):
                    found.append((hub, node))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = wanted.join(texts, "node").select("hub", "run", "part", "node", "text")
    return durable(rows.repartition("hub", "run").sortWithinPartitions("hub", "run", "part").mapInArrow(compare, "a long, b long"))


def _labelled(nodes: DataFrame, component: DataFrame) -> DataFrame:
    return nodes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _across(left: DataFrame, near: Column) -> DataFrame:
    """Pairs of (component, size) on one list under different components, where ``near`` holds for a and b."""
    a, b = left.alias("a"), left.alias("b")
    return (a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.component") < F.col("b.component")) & near)
            .select(F.col("a.token").alias("on"), F.col("a.component").alias("ca"), F.col("a.n").alias("na"), F.col("b.component").alias("cb"), F.col("b.n").alias("nb")))


def _expanded(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """Pairs of the nodes such pairs of (component, size) have on their list."""
    a, b = postings.alias("a"), postings.alias("b")
    return (groups.join(a, (F.col("on") == F.col("a.token")) & (F.col("ca") == F.col("a.component")) & (F.col("na") == F.col("a.n")))
            .join(b, (F.col("on") == F.col("b.token")) & (F.col("cb") == F.col("b.component")) & (F.col("nb") == F.col("b.n")))
            .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())


def _by_signature(prefix: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates from short lists: pairs that share MATCHES coordinates, counted by look-up in both signatures."""
    near = _similar_size(F.col("a.n"), F.col("b.n"))
    groups = _across(prefix.select("token", "component", "n").distinct(), near)
    pairs = _expanded(groups, prefix)
    own, other = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa")), nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, SIZE) for k in (2, 3))
            keep = pa.array((x == y).sum(1) >= MATCHES)
            yield batch.select([0, 1]).filter(keep)

    return pairs.join(own, "a").join(other, "b").select("a", "b", "sa", "sb").mapInArrow(count, "a long, b long")


def _blocks_compared(classes: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (``a, b``) between the members of paired classes (``ca, na, cb, nb``), by blocks and not by pairs.

    The component with more members is the hub. All nodes paired with one size of
    a hub meet its members of that size: both are dealt into blocks, and each
    block of members goes once to each block of the others. A task holds a block
    of sets and one other set. One link of a node to a block is enough to join it.
    """
    many = members.groupBy("component").agg(F.count(F.lit(1)).alias("many"))
    counted = classes.join(many.toDF("ca", "ma"), "ca").join(many.toDF("cb", "mb"), "cb")
    swap = F.col("mb") > F.col("ma")
    side = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    met = durable(counted.select(side("ca", "cb").alias("hub"), side("na", "nb").alias("size"), side("cb", "ca").alias("other"), side("nb", "na").alias("n")).distinct())
    own = met.select("hub", "size").distinct().join(members.toDF("hub", "size", "node"), ["hub", "size"])
    others = met.join(members.toDF("other", "n", "node"), ["other", "n"]).select("hub", "size", "node").distinct()
    sets = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_SHINGLES) / F.col("size"))))
    blocks = lambda rows, name: rows.groupBy("hub", "size").agg(F.count(F.lit(1)).alias(name)).withColumn(name, F.ceil(F.col(name) / sets))
    shape = durable(blocks(own, "rows").join(blocks(others, "columns"), ["hub", "size"]))
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    key = ["hub", "size", "row", "column"]
    dealt = own.join(shape, ["hub", "size"]).select("hub", "size", place("rows").alias("row"), each("columns", "column"), F.lit(0).alias("part"), "node").union(
        others.join(shape, ["hub", "size"]).select("hub", "size", each("rows", "row"), place("columns").alias("column"), F.lit(1).alias("part"), "node"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, nodes, tokens, owner, sizes = None, [], [], None, None, None
        for batch in batches:
            found = []
            for *own, part, node, text in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6)):
                s = shingle_set(text.as_py())
                if own != at:
                    at, held, nodes, tokens = own, [], [], None
                if part == 0:
                    held.append(s)
                    nodes.append(node)
                elif held:
                    if tokens is None:
                        sizes = np.array([len(x) for x in held])
                        tokens, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
                        order = np.argsort(tokens, kind="stable")
                        tokens, owner = tokens[order], owner[order]
                    low, high = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
                    length = high - low
                    spread = np.repeat(low - np.cumsum(length) + length, length) + np.arange(length.sum())
                    common = np.bincount(owner[spread], minlength=len(held))
                    near = np.flatnonzero(100 * common >= PERCENT * (sizes + len(s) - common))
                    if len(near):
                        found.append((nodes[near[0]], node))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = dealt.join(texts, "node").select(*key, "part", "node", "text")
    return durable(rows.repartition(*key).sortWithinPartitions(*key, "part").mapInArrow(compare, "a long, b long"))


def _by_set(flagged: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among the flagged nodes, by the rarest part of their full sets: complete within PERCENT."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, component, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingle_set(text.as_py()).view(np.int64)
                same = lambda x: pa.array(np.full(len(s), x, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(s), same(node), same(component), same(len(s))], ["token", "node", "component", "n"])

    rows = durable(flagged.join(texts, "node").select("node", "component", "text").mapInArrow(explode, "token long, node long, component long, n long"))
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("node").orderBy("df", "token")
    placed = rows.join(often, "token").withColumn("at", F.row_number().over(order) - 1)
    prefix = durable(placed.where((F.col("df") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100))).drop("df"))
    na, nb = F.col("a.n"), F.col("b.n")
    # The least number of common shingles, and what a common shingle at these places leaves possible.
    least = F.ceil((na + nb) * PERCENT / (100 + PERCENT))
    near = _similar_size(na, nb) & (F.least(na - F.col("a.at"), nb - F.col("b.at")) >= least)
    groups = _across(prefix.groupBy("token", "component", "n").agg(F.min("at").alias("at")), near).select("ca", "na", "cb", "nb").distinct()
    # Nodes of one component and size share most of their tokens, so classes of them are paired, and never their nodes.
    members = durable(prefix.select("component", "n", "node").distinct())
    return _blocks_compared(groups, members, texts)


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``near_duplicates`` with each text's ``digest``."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = durable(_signed(chosen))
    own = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    nodes = durable(rows.where(own).groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("signature").alias("signature"))
                    .withColumn("node", F.monotonically_increasing_id()))

    # Windows deal the postings out once by token and once by node; aggregates joined back would do so twice each.
    by_token, by_node = Window.partitionBy("token"), Window.partitionBy("node")
    shared = _postings(nodes).withColumn("df", F.count(F.lit(1)).over(by_token)).where("df > 1")
    lists = durable(shared.withColumns({"weight": F.sum(F.log("df")).over(by_node), "listed": F.count(F.lit(1)).over(by_node)}))

    # Stars: the leader of a list is the node whose values are the most common.
    lead = F.max(F.struct("weight", (-F.col("node")).alias("order"))).over(by_token)
    stars = (lists.select("token", "node", "weight").withColumn("leader", -lead["order"])
             .where(F.col("node") != F.col("leader")).groupBy("leader", "node").agg(F.count(F.lit(1)).alias("common"))
             .where(F.col("common") >= MATCHES).select(F.col("leader").alias("a"), F.col("node").alias("b")))
    stars = durable(stars)

    # The rarest coordinates: those on no list come first, so a node with enough of them has no prefix at all.
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "token")) + SIZE - F.col("listed")
    prefix = durable(lists.where(F.col("listed") >= MATCHES).withColumn("rank", rank)
                     .where(F.col("rank") <= SIZE - MATCHES + 1).select("token", "node"))

    # The texts of nodes that can be in a pair at all, once.
    active = prefix.select("node").union(stars.select("a")).union(stars.select("b")).distinct()
    folder = shared_folder(spark, "near-duplicates")
    wanted = active.join(nodes.select("node", "doc", "digest"), "node")

    def of_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where texts share an id, the one whose set is the node's."""
        for batch in batches:
            same = [set_digest(shingle_set(t.as_py())) == d for t, d in zip(batch.column(2), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_())).select([0, 2])

    (chosen.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("doc")).select("node", "digest", "text").mapInArrow(of_node, "node long, text string")
     .write.parquet(folder))
    texts = spark.read.parquet(folder)
    # A row that repeats an id and its text gives its node a second text of the same set, and places in a set need one.
    # Rarely needed, and it would sort all texts.
    if not texts.groupBy("node").agg(F.count(F.lit(1)).alias("times")).where("times > 1").isEmpty():
        texts = durable(texts.dropDuplicates(["node"]))

    links = [_confirmed(stars, texts)]
    component = components(links[0])
    sized = durable(_labelled(nodes.select("node", "n").join(active, "node"), component))
    prefix = prefix.join(sized, "node")
    lengths = prefix.select("token", "component").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    prefix = durable(prefix.join(lengths, "token"))
    links.append(_confirmed(_by_signature(prefix.where(F.col("many") <= LONG_LIST).select("token", "node", "component", "n"), nodes), texts))
    flagged = prefix.where(F.col("many") > LONG_LIST).select("node", "component").distinct()
    links.append(_by_set(flagged, texts))

    final = components(reduce(DataFrame.union, links))
    member = nodes.select("node", "doc", "digest").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = member.groupBy("component").agg(F.min("doc").alias("component_id"))
    # Written before the join, so that Spark can split the many rows of one digest over tasks.
    by_digest = durable(member.join(smallest, "component").select("digest", "component_id"))
    joined = rows.join(by_digest, "digest", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "digest", F.col("n").alias("n_shingles"), component_id.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per document.

    Documents are linked where their shingle sets' similarity is at least
    PERCENT of 100; ``component_id`` is the smallest id reachable by links, and
    ``kept`` marks the document of that id. Null, empty and wordless texts have
    no shingles and are linked with nothing. A row without an id cannot stand
    for a group: it takes no part, its component is null and it is kept. Rows
    that repeat an id and a text get equal rows; where texts differ under one
    id, each text is linked for itself. An empty table gives no rows; other
    columns are not read.
    """
    return _linked(docs, id_col, text_col).drop("digest")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their group; of rows that repeat an id and a text, one."""
    found = durable(_linked(docs, "doc_id", "text").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id"), "digest", "kept"))
    kept = durable(found.groupBy("kept_id").agg(F.count_if("kept").alias("times"), F.count_if(~F.col("kept")).alias("copies")).where("times > 0"))
    own = docs.join(kept.select("kept_id").hint("shuffle_hash"), F.col("doc_id") == F.col("kept_id"), "left_semi")
    # Ids under which one text stands for its group and another is a copy; their texts are told apart by their sets.
    mixed = kept.where("copies > 0").select("kept_id")
    if not mixed.isEmpty():
        pairs = found.where("kept").join(mixed, "kept_id").select("kept_id", F.col("digest").alias("kept_digest")).distinct()

        def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = (shingle_set(t) for t in batch.column("text").cast(pa.string()).to_pylist())
                digests = pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, digests], [*batch.schema.names, "own_digest"])

        schema = StructType([*docs.schema.fields, StructField("own_digest", BinaryType())])
        some = own.join(mixed, F.col("doc_id") == F.col("kept_id"), "left_semi").mapInArrow(digested, schema)
        some = some.join(pairs, (F.col("doc_id") == F.col("kept_id")) & F.col("own_digest").eqNullSafe(F.col("kept_digest")), "left_semi").drop("own_digest")
        own = own.join(mixed, F.col("doc_id") == F.col("kept_id"), "left_anti").unionByName(some)
    # Rarely needed, and it would sort all texts.
    if not kept.where("times > 1").isEmpty():
        own = own.dropDuplicates(["doc_id", "text"])
    return own.unionByName(docs.where("doc_id IS NULL"))
