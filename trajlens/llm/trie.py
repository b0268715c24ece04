"""A prefix trie of conversations by fixed-length block hashing.

1. Turns become digests, and every BLOCK turns of a conversation one block with
   a digest. The key of a prefix is the sum of the hashes of its blocks, each
   hashed with its place, so it is a running sum and no task needs a whole
   conversation.
2. Equal conversations are one, with a count. The rest is done for these.
3. Blocks are grouped by the key before them and their own digest: that is the
   trie of blocks.
4. Turns are refined inside blocks. Where one block alone follows a prefix, its
   turns are nodes as they stand. Only where siblings diverge are the blocks'
   turn prefixes compared.
5. Each node is owned by its smallest member, which then owns the rest of its own
   path. What a subtree adds up to is what its members own, less what the owner
   owns above: one more grouping and a running sum, and no walk up the levels.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.sequence import Ordered, chunk_limit, number_rows
from trajlens.session import durable

#: Turns of a block.
BLOCK = 4
#: Ids that can lie in one part of a list to be hashed.
IDS_A_PART = 4096
#: Parts that the blocks after one prefix are dealt to.
PARTS = 16

_KEY = ["p1", "p2"]
_SUM = "decimal(38,0)"


def _hashes(*cols: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *cols).cast(_SUM) for seed in (1, 2)]


def ordered_turns(conversations: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """``conv, step, role, text``: every conversation's turns, numbered from 1 in order of ``turn``.

    Null turns come first, ties go by role and text; null roles and texts are
    empty; rows without a ``conv_id`` belong to no conversation and are left out.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn"),
                                                             F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return number_rows(rows, ["conv"], ["turn", "role", "text"], "step", chunk_rows).df.select("conv", "step", "role", "text")


def with_shared_openings(turns: DataFrame, family: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their family does.

    Conversation c is the first h turns of conversation c - c % ``family`` (all
    if fewer, none if absent), then its own turns after its first h; h is the
    CRC-32 of c's decimal digits modulo ``longest``. Returns ``conv, depth, role,
    text`` of the turns and ``conv, n_turns`` of all conversations, also of those left
    without a turn.
    """
    turns = durable(turns)
    sizes = durable(turns.groupBy("conv").agg(F.max("step").alias("size")))
    first = sizes.select(F.col("conv").alias("of"), F.col("size").alias("there"))
    kept = F.crc32(F.col("conv").cast("string")) % longest
    plan = (sizes.withColumn("h", kept).withColumn("of", F.col("conv") - F.col("conv") % family).join(first, "of", "left")
            .withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    plan = durable(plan.select("conv", "of", "h", "taken", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("n_turns")))
    opening = turns.where(F.col("step") < longest).withColumnRenamed("conv", "of")
    borrowed = plan.select("conv", "of", "h").join(opening, "of").where(F.col("step") <= F.col("h")).select("conv", F.col("step").alias("depth"), "role", "text")
    own = turns.join(plan.select("conv", "h", "taken"), "conv").where(F.col("step") > F.col("h")).select(
        "conv", (F.col("taken") + F.col("step") - F.col("h")).alias("depth"), "role", "text")
    return borrowed.unionByName(own), plan.select("conv", "n_turns")


def _blocks(turns: DataFrame, longest: int, chunk_rows: int) -> DataFrame:
    """``conv, k, p1, p2, whole, prefixes, sizes, h1, h2``: blocks with the key before them and the digests of their turn prefixes."""
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = turns.select("conv", F.expr(f"(depth - 1) div {BLOCK}").alias("k"), F.struct("depth", digest.alias("digest"), F.octet_length("text").cast("long").alias("size")).alias("turn"))
    # At most BLOCK turns in a list.
    listed = rows.groupBy("conv", "k").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    digests = F.transform("turns", lambda t: t["digest"])
    prefix = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda j: F.sha2(F.array_join(F.slice(digests, 1, j), ""), 256))
    made = listed.select("conv", "k", prefix.alias("prefixes"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    made = made.withColumn("whole", F.element_at("prefixes", -1))
    h1, h2 = _hashes(F.col("k"), F.size("prefixes").cast("long"), F.col("whole"))
    made = made.select("*", (F.col("k") + 1).alias("place"), h1.alias("h1"), h2.alias("h2"))
    placed = Ordered(made, ("conv",), "place", -(-longest // BLOCK), chunk_rows)
    placed = placed.running(exclusive=True, p1=("sum", F.col("h1")), p2=("sum", F.col("h2")))
    return placed.result().drop("place").withColumns({c: F.coalesce(c, F.lit(0)).cast(_SUM) for c in _KEY})


def _nodes(blocks: DataFrame, **sums: str) -> DataFrame:
    """``depth, p1, p2, above1, above2, conv, size`` and the sums of each node: turn prefixes of the blocks' trie."""
    total = [F.sum(c).alias(n) for n, c in sums.items()]
    groups = durable(blocks.groupBy("k", *_KEY, "whole").agg(*total, F.min("conv").alias("conv"), F.first("prefixes").alias("prefixes"), F.first("sizes").alias("sizes")))
    content = ["whole", *sums, "conv", "prefixes", "sizes"]
    parents = durable(groups.groupBy("k", *_KEY).agg(F.count(F.lit(1)).alias("many"), F.first(F.struct(*content)).alias("only")))
    place = ["k", *_KEY]
    alone = parents.where("many = 1").select(*place, "only.*")
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    split = groups.withColumn("part", F.pmod(F.xxhash64("whole"), F.lit(PARTS)).cast("int"))
    split = split.join(parents.where("many > 1").select(*place, parts), [*place, "part"], "left_semi").drop("part")

    def turns(rows: DataFrame) -> DataFrame:
        each = F.posexplode("prefixes").alias("at", "prefix")
        rows = rows.select(*place, *sums, "conv", "prefixes", "sizes", each)
        before = F.when(F.col("at") > 0, F.element_at("prefixes", F.greatest(F.col("at"), F.lit(1))))
        return rows.select(*place, (F.col("at") + 1).cast("long").alias("j"), "prefix", before.alias("before"), F.element_at("sizes", F.col("at") + 1).alias("size"), "conv", *sums)

    refined = turns(split).groupBy(*place, "j", "prefix").agg(*[F.sum(n).alias(n) for n in sums], F.min("conv").alias("conv"),
                                                             F.first("before").alias("before"), F.first("size").alias("size"))
    every = turns(alone).unionByName(refined)
    own, above = _hashes(F.col("k"), F.col("j"), F.col("prefix")), _hashes(F.col("k"), F.col("j") - 1, F.col("before"))
    up = lambda base, h: F.when(F.col("j") > 1, base + h).otherwise(base).cast(_SUM)
    return every.select((F.col("k") * BLOCK + F.col("j")).alias("depth"), *[(F.col(b) + h).cast(_SUM).alias(b) for b, h in zip(_KEY, own)],
                        *[up(F.col(b), h).alias(f"above{i}") for i, (b, h) in enumerate(zip(_KEY, above), 1)], "conv", "size", *sums)


def _listed_ids(members: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends``: SHA-256 of the ids of the conversations that end there, ascending and joined by commas.

    Ids meet in parts of at most IDS_A_PART; the parts of a node are hashed one
    after the other, so a task holds one of them.
    """
    key = ["depth", *_KEY]
    part = F.floor(F.col("conv") / IDS_A_PART)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    parts = members.groupBy(*key, part.alias("part")).agg(ids.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), *(pa.array([p], pa.decimal128(38, 0)) for p in at[1:]), pa.array([digest.hexdigest()])],
                                              [*key, "ends"])

        for batch in batches:
            for depth, p1, p2, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if at != (depth, p1, p2):
                    if at is not None:
                        yield row()
                    at, digest = (depth, p1, p2), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
        if at is not None:
            yield row()

    dealt = parts.repartition(*key).sortWithinPartitions(*key, "part").select(*key, "ids")
    return dealt.mapInArrow(hashed, f"depth long, p1 {_SUM}, p2 {_SUM}, ends string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` (``conv, depth, role, text``) has depths from 1 without gaps,
    ``conversations`` (``conv, n_turns``) every conversation once. A node is a
    different sequence of first turns; ``conv_id`` is its smallest member,
    ``n_convs`` its members, ``n_leaves`` the childless nodes of its subtree and
    ``saved_tokens`` the bytes of last texts that the subtree's members share
    beyond their first. ``ends_sha256`` is taken of the ids that end in the
    node. The root is there as soon as there is a conversation, also one
    without turns; without any there are no rows. Equal conversations are
    members of the same nodes. Other columns are not read.
    """
    chunk_rows = chunk_limit(turns, chunk_rows)
    whole = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.max("n_turns").alias("longest")).first()
    blocks = durable(_blocks(turns, whole.longest or 0, chunk_rows))
    ends = blocks.groupBy("conv").agg(*[F.sum(h).cast(_SUM).alias(p) for h, p in zip(("h1", "h2"), _KEY)])
    members = durable(conversations.join(ends, "conv", "left").select("conv", F.col("n_turns").alias("depth"), *[F.coalesce(p, F.lit(0)).cast(_SUM).alias(p) for p in _KEY]))
    classes = members.groupBy("depth", *_KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("members"))
    kept = durable(blocks.drop("h1", "h2").join(classes.select("conv", "members"), "conv"))

    nothing = F.lit(0).cast(_SUM)
    root = turns.sparkSession.range(1 if whole.n else 0).select(
        F.lit(0).cast("long").alias("depth"), nothing.alias("p1"), nothing.alias("p2"), F.lit(None).cast(_SUM).alias("above1"), F.lit(None).cast(_SUM).alias("above2"),
        F.lit(whole.conv).cast("long").alias("conv"), F.lit(0).cast("long").alias("size"), F.lit(whole.n).cast("long").alias("n"))
    nodes = durable(_nodes(kept, n="members").unionByName(root))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above1").alias("p1"), F.col("above2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["depth", *_KEY], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("saved", (F.col("n") - 1) * F.col("size")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = durable(nodes.withColumn("place", F.col("depth") + 1))

    # What the members of a node own, all along their paths.
    owned = durable(nodes.groupBy("conv").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")))
    below = _nodes(kept.join(owned, "conv"), below_saved="saved", below_leaves="leaf").select("depth", *_KEY, "below_saved", "below_leaves")
    sums = owned.agg(F.sum("saved").alias("below_saved"), F.sum("leaf").alias("below_leaves"))
    at_root = sums.where("below_leaves IS NOT NULL").select(F.lit(0).cast("long").alias("depth"), nothing.alias("p1"), nothing.alias("p2"), "below_saved", "below_leaves")
    above = Ordered(nodes, ("conv",), "place", (whole.longest or 0) + 1, chunk_rows).running(exclusive=True, owned_above=("sum", F.col("saved"))).result()
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("above1"), F.col("p2").alias("above2"), F.col("conv").alias("parent_conv_id"))
    full = (above.join(below.unionByName(at_root), ["depth", *_KEY]).join(parent, ["depth", "above1", "above2"], "left")
            .join(_listed_ids(members), ["depth", *_KEY], "left"))
    return full.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("below_leaves").alias("n_leaves"),
                       (F.col("below_saved") - F.coalesce("owned_above", F.lit(0))).cast("long").alias("saved_tokens"),
                       F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
