"""Prefix trie of conversations, built level by level.

Every conversation is one row of turns (place from 1, digest of role and text, words). At each depth the live
conversations, those whose node still has other members, are grouped by (parent node, next turn); the least
conv_id of a group names its node, so (depth, conv_id) identifies nodes and parents alike. A conversation that is
alone in its group leaves: the rest of its turns is a chain of nodes with one member, whose figures need no
further level. The loop ends with the deepest shared prefix. Then the shared levels are rolled up from the
deepest: each node adds its children's leaves and savings to its own.

Groups are counted with map-side combination; live conversations look up their group by a join that is split
for groups of a thousandth of all rows or more. Every level is a written table, so no plan grows with depth.

The digest of a node's ended members is over one text in one order: members are sorted in ranges, each range gives
pieces of bounded size, and the pieces of a node run through one digest, so memory never grows with a node.

Cases: rows without conv_id belong to no conversation and are left out; null role or text is empty; a null turn comes
first, rows of one turn are ordered by role and text, and equal rows are turns each; a conversation without any
turn left is a member of the root alone; without any conversation there is no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WS, frequent_from, split_join, stash, text_or_empty

#: Ids of a piece of an ended members' text.
PIECE_IDS = 16_384


def _digest() -> Column:
    """256 bits of role and text; the role's length keeps the two apart."""
    role, text = text_or_empty("role"), text_or_empty("text")
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), key, words: the turns as they stand in the table."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), text_or_empty("role"), text_or_empty("text"))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.row_number().over(order).cast("long").alias("place"),
        _digest().alias("key"),
        F.regexp_count(text_or_empty("text"), F.lit(f"[^{WS}]+")).cast("long").alias("words"),
    )


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) and turns of the rebuilt conversations.

    The first crc32(conv_id) % heads turns are those of conversation conv_id - conv_id % every, as far as it has
    them; the conversation's own turns after as many follow.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    cid = F.col("conv_id")
    plan = sizes.select("conv_id", "n", (F.crc32(cid.cast("string").cast("binary")) % heads).alias("h"), (cid - cid % every).alias("base"))
    at_base = sizes.filter(cid % every == 0).select(cid.alias("base"), F.col("n").alias("n_base"))
    plan = plan.join(at_base, "base", "left").withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = stash(plan.select("conv_id", "h", "base", "lead", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "plan")
    own = turns.join(plan.select("conv_id", "h", "lead"), "conv_id").filter("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("place"), "key", "words")
    head = turns.filter((cid % every == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    lent = head.join(plan.filter("lead > 0").select("conv_id", "base", "lead"), "base").filter("place <= lead")
    return plan.select("conv_id", "n"), own.unionByName(lent.select("conv_id", "place", "key", "words"))


_PIECES = "depth long, node long, first long, ids binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, joined by commas; rows come in the order of depth, node and conv_id."""
    held: list[int] = []
    at = None

    def piece() -> pa.RecordBatch:
        arrays = [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held)).encode()])]
        return pa.RecordBatch.from_arrays(arrays, ["depth", "node", "first", "ids"])

    for batch in batches:
        for depth, node, conv in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if held and ((depth, node) != at or len(held) >= PIECE_IDS):
                yield piece()
                held = []
            at = (depth, node)
            held.append(conv)
    if held:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node; its pieces come in order."""
    at = running = None

    def done() -> pa.RecordBatch:
        arrays = [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([running.hexdigest()])]
        return pa.RecordBatch.from_arrays(arrays, ["depth", "node", "ends_sha256"])

    for batch in batches:
        for depth, node, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if (depth, node) != at:
                if at is not None:
                    yield done()
                at, running = (depth, node), hashlib.sha256(ids)
            else:
                running.update(b"," + ids)
    if at is not None:
        yield done()


def member_digests(ends: DataFrame) -> DataFrame:
    """depth, node, ends_sha256 from ends(depth, node, conv_id): SHA-256 of the ascending ids joined by commas."""
    order = ["depth", "node", "conv_id"]
    ranged = ends.select(*[F.col(c).cast("long").alias(c) for c in order]).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranged.mapInArrow(_pieces, _PIECES)
    return (
        pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
        .mapInArrow(_digests, "depth long, node long, ends_sha256 string")
    )


def _levels(convs: DataFrame, turns: DataFrame, root: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """groups and live of each depth from 1.

    groups: parent, node, n_convs, words, n (of the longest member); live: conv_id, parent, n of the members of shared nodes.
    """
    levels, members = [], []
    live = convs.filter("n > 0").select("conv_id", F.lit(root).cast("long").alias("parent"), "n")
    while True:
        depth = len(levels) + 1
        step = live.filter(F.col("n") >= depth).join(turns.filter(F.col("place") == depth).select("conv_id", "key", "words"), "conv_id")
        counted = step.groupBy("parent", "key").agg(
            F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("n").alias("n")
        )
        groups = stash(counted, "level")
        shared = groups.filter("n_convs > 1").select("parent", "key", "node", F.col("n_convs").alias("times"))
        total = shared.agg(F.sum("times")).first()[0]
        levels.append(groups.drop("key"))
        if not total:
            return levels, members
        looked = split_join(step.select("conv_id", "parent", "key", "n"), shared, ["parent", "key"], frequent_from(total))
        live = stash(looked.select("conv_id", F.col("node").alias("parent"), "n"), "live")
        members.append(live)


def report(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(*rebuilt(stash(turns_of(conversations), "turns")))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of any conversations: convs(conv_id, n) and turns(conv_id, place from 1, key, words)."""
    # Sorted by place within files, so that a level reads its own pages of them.
    turns = stash(turns.sortWithinPartitions("place"), "rebuilt")
    root, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    levels, members = _levels(convs, turns, root if root is not None else 0)
    none = hashlib.sha256(b"").hexdigest()

    # Those that leave at a depth: chains of nodes with one member.
    alone = None
    for depth, groups in enumerate(levels, 1):
        left = groups.filter("n_convs = 1").select(F.col("node").alias("conv_id"), "parent", F.lit(depth).cast("long").alias("begin"), "n")
        alone = left if alone is None else alone.unionByName(left)
    chains = alone.withColumn("depth", F.explode(F.sequence("begin", "n"))).select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("begin"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("depth") == F.col("n"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"),
    )

    # The shared nodes, the deepest level first, and the root last.
    top = convs.sparkSession.range(1).filter(F.lit(bool(n_convs))).select(
        F.lit(None).cast("long").alias("parent"), F.lit(root).cast("long").alias("node"), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words")
    )
    shared, below = None, None
    for depth in range(len(levels) - 1, -1, -1):
        own = top if depth == 0 else levels[depth - 1].filter("n_convs > 1").select("parent", "node", "n_convs", "words")
        kids = levels[depth].filter("n_convs = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        if below is not None:
            kids = kids.unionByName(below.select("parent", "n_leaves", "saved_tokens"))
        sums = kids.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        below = stash(
            own.join(sums, "node", "left").select(
                "parent", "node", F.lit(depth).cast("long").alias("depth"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
            ),
            "rolled",
        )
        shared = below if shared is None else shared.unionByName(below)
    ends = convs.filter("n = 0").select(F.lit(0).alias("depth"), F.lit(root).cast("long").alias("node"), "conv_id")
    for depth, live in enumerate(members, 1):
        ends = ends.unionByName(live.filter(F.col("n") == depth).select(F.lit(depth).alias("depth"), F.col("parent").alias("node"), "conv_id"))
    named = shared.join(member_digests(ends), ["depth", "node"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
    return named.unionByName(chains)
