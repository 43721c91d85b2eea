"""From keys that classes of documents share to the components of their links.

A class is a set of shingles that one or more documents have; its node is a 128-bit digest of the set. Operators
give each class keys such that linked classes share one, and a cheap test that no linked pair fails (or fails
with a stated probability); here candidates become links that are confirmed on full sets, and links become components.

Keys of the same members are one. Candidates come from stars: members of a key are compared with a few of the key's members, never
all with all, inside a join that makes rows for likely pairs alone. Only where a key still holds several components are members
of different components compared, inside such a join too; such a key is split by set size (similar sets have similar sizes) and, beyond SPLIT members,
dealt out to several tasks. Keys, centres and components that hold a thousandth of all rows or more are joined by
broadcast or dealt out with copies of their one partner row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm.common import copied_join, drop_shuffles, frequent_from, release_stashes, split_join, stash, stashes_made
from corpusloom.llm.components import connected

#: Links: PER_CENT * union <= 100 * intersection.
PER_CENT = 80
#: Centres of a key in the second round of stars, and members of a key and size class that meet in one task.
CENTRES, SPLIT = 8, 2048
#: Sizes of one class differ by less than this factor; above 1 / 0.8, so that linked sets are in the same class or in neighbours.
SIZE_STEP = 1.3


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits of a set of 64-bit hashes; equal sets have equal ones."""
    size = np.uint64(len(hashes))
    mixed = K.mix(hashes + np.uint64(7))
    second = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)
    return K.mix(np.array([mixed.sum() + size, (second ^ (second >> np.uint64(32))).sum() - size], np.uint64)).tobytes()


def similar(a: Column, b: Column) -> Column:
    """Whether two full sets are linked."""
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * PER_CENT


def similar_sizes(x: Column, y: Column) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * PER_CENT


class Sets:
    """Full sets of classes, made when pairs first ask for them: sets_of gives node, hashes of a table of nodes."""

    def __init__(self, sets_of: Callable[[DataFrame], DataFrame]):
        self.sets_of, self.held = sets_of, None

    def of(self, wanted: DataFrame) -> DataFrame:
        wanted = stash(wanted.select("node").distinct(), "wanted")
        new = wanted if self.held is None else stash(wanted.join(self.held.select("node"), "node", "left_anti"), "wanted")
        if self.held is None or not new.isEmpty():
            made = stash(self.sets_of(new), "sets")
            self.held = made if self.held is None else self.held.unionByName(made)
        return self.held.join(wanted, "node", "left_semi")


def confirmed(pairs: DataFrame, made: Sets) -> DataFrame:
    """The pairs u, v whose full sets are linked."""
    sets = made.of(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
    first = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u")
    both = copied_join(pairs, first, sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    return both.filter(similar(F.col("a"), F.col("b"))).select("u", "v")


def merged(shared: DataFrame) -> DataFrame:
    """key, node: one key in place of all those that the same classes have, which would bring the same pairs.

    The new key is a hash of its members; where two sets of members have one hash, the key has the members of both, so no pair is lost.
    """
    keys = stash(shared.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("same"), F.count("*").alias("times")), "keys")
    rows = keys.agg(F.sum("times")).first()[0]
    return split_join(shared, keys, ["key"], frequent_from(rows or 1)).select(F.col("same").alias("key"), "node").distinct()


def placed(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """key, node, root of the shared keys' members."""
    if roots is None:
        return shared.select("key", "node", F.col("node").alias("root"))
    return stash(shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")


def still_open(members: DataFrame, centres: range) -> DataFrame:
    """Those members whose key holds more than one component, with held (the key's members) and centre.

    A key's centres are those of its members that have the least of a hash; each number in centres stands for another hash.
    """
    hashes = [F.xxhash64("node", F.lit(k)) for k in centres]
    keys = stash(
        members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("held"), *[F.min(h).alias(f"h{k}") for k, h in zip(centres, hashes)])
        .filter("lo < hi").withColumn("times", F.col("held")).drop("lo", "hi"), "open",
    )
    rows = keys.agg(F.sum("held")).first()[0]
    centre = F.lit(False)
    for k, h in zip(centres, hashes):
        centre = centre | (h == F.col(f"h{k}"))
    return split_join(members, keys, ["key"], frequent_from(rows or 1)).select("key", "node", "root", "held", centre.alias("centre"))


def stars(open_: DataFrame) -> DataFrame:
    """The centres among the members of open keys."""
    return open_.filter("centre")


def met(open_: DataFrame, signed: DataFrame, close: Column) -> DataFrame:
    """u, v: the members of a key with those of the key's centres that are in other components and pass the cheap test.

    The test is a condition of the join, so that no row is made for a pair that fails it. The centres of frequent keys are broadcast.
    """
    least = frequent_from(open_.count())
    often = F.col("held") >= least
    with_signs = lambda rows: rows.select("key", "node", "root").join(signed, "node")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & close
    centres = stars(open_)
    pairs = with_signs(open_.filter(~often)).alias("x").join(with_signs(centres.filter(~often)).alias("y"), meet)
    pairs = pairs.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"))
    hot = stash(with_signs(centres.filter(often)), "hot")
    if not hot.isEmpty():
        some = with_signs(open_.filter(often)).alias("x").join(F.broadcast(hot).alias("y"), meet)
        pairs = pairs.unionByName(some.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")))
    return pairs.distinct()


def likely(pairs: DataFrame, signed: DataFrame, close: Column) -> DataFrame:
    """The pairs that pass the cheap test, which looks at the columns of signed as x and y."""
    first = pairs.join(signed.select(F.col("node").alias("u"), F.struct(*signed.columns).alias("x")), "u")
    both = copied_join(pairs, first, signed.select(F.col("node").alias("v"), F.struct(*signed.columns).alias("y")), "v")
    return both.filter(close).select("u", "v")


def _blocks(rows: DataFrame, as_partner: bool, by_size: bool = True) -> DataFrame:
    """rows with block: a class and its possible partners have one block in common, for each key and size class.

    by_size false is for keys that sets of similar sizes alone have. A class stands in one block of its key: its size class and one of the parts that a large key has. As a partner it
    stands in the three size classes around its own, in every part.
    """
    size = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")
    size = size if by_size else F.lit(0)
    parts = F.ceil(F.col("held") / SPLIT).cast("int")
    if not as_partner:
        return rows.withColumn("block", F.struct("key", size.alias("size"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part")))
    sizes = F.array(*[size + k for k in ((-1, 0, 1) if by_size else (0,))])
    return (
        rows.withColumn("_size", F.explode(sizes)).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("block", F.struct("key", F.col("_size").alias("size"), F.col("_part").alias("part"))).drop("_size", "_part")
    )


def across(open_: DataFrame, signed: DataFrame, made: Sets, close: Column) -> DataFrame:
    """The links u, v between members of one key in different components.

    Rows without a likely partner leave first, by a semi-join; the others carry their full sets into
    the join. Both look at a pair in the least of its common open keys only, and the second confirms it
    there, so that no row is made for a pair that is no link.
    """
    keys = open_.groupBy("node").agg(F.collect_set("key").alias("keys"))  # a class has so many keys at most
    rows = stash(open_.select("key", "node", "root", "held").join(signed, "node").join(keys, "node"), "mixed")
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    meet = (F.col("x.block") == F.col("y.block")) & (F.col("x.root") != F.col("y.root")) & close & once
    some = stash(_blocks(rows, False).alias("x").join(_blocks(rows, True).alias("y"), meet, "left_semi").drop("block"), "some")
    full = stash(some.join(made.of(some), "node"), "likely")
    return (
        _blocks(full, False).alias("x")
        .join(_blocks(full, True).alias("y"), meet & (F.col("x.root") < F.col("y.root")) & similar(F.col("x.hashes"), F.col("y.hashes")))
        .select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"))
    )


def likely_across(open_: DataFrame, signed: DataFrame, close: Column) -> DataFrame:
    """u, v: members of one key in different components that pass the cheap test, each pair once.

    For classes of hundreds of keys, whose sets or keys would be copied too often, with tests that few strangers pass and
    keys that sets of similar sizes alone have.
    """
    rows = open_.select("key", "node", "root", "held").join(signed, "node")
    meet = (F.col("x.block") == F.col("y.block")) & (F.col("x.root") < F.col("y.root")) & close
    pairs = _blocks(rows, False, by_size=False).alias("x").join(_blocks(rows, True, by_size=False).alias("y"), meet)
    return pairs.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()


def components(
    shared: DataFrame, signed: DataFrame, close: Column, sets_of: Callable[[DataFrame], DataFrame], many_keys: bool = False,
    finer: tuple[DataFrame, Column] | None = None,
) -> DataFrame | None:
    """node, root of the classes that are linked with others and are not the least of their component; None: no two are linked.

    shared: key, node of the keys that several classes have, as merged() gives them; signed: node, size and what close looks at, as x and y;
    sets_of: node, hashes of the nodes asked for; many_keys: see likely_across(); finer: a larger table as signed and a second exact
    test over it, for the pairs that pass the first, before full sets are sent for them. Stars first, from one centre and then from several, as they cost no
    more than their rows; then every pair of members that are still in different components.
    """
    sets, roots = Sets(sets_of), None
    for centres in (range(1), range(1, 1 + CENTRES), range(0)):
        mark = stashes_made()
        members = placed(shared, roots)
        open_ = stash(still_open(members, centres), "members")
        if open_.isEmpty():
            break
        if centres or many_keys:
            pairs = stash(met(open_, signed, close) if centres else likely_across(open_, signed, close), "pairs")
            if finer is not None:
                pairs = stash(likely(pairs, *finer), "finer")
            release_stashes(mark, stashes_made() - 1)  # the pairs are all that is needed of the members
            drop_shuffles(shared.sparkSession)
            found = confirmed(pairs, sets)
        else:
            found = across(open_, signed, sets, close)
        found = stash(found, "links")
        drop_shuffles(shared.sparkSession)
        if not found.isEmpty():
            if roots is not None:
                found = found.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
            roots = connected(found)
    return roots


def all_links(shared: DataFrame, signed: DataFrame, close: Column, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """u, v: every link between two classes; the result itself may be as large as the square of a group."""
    open_ = stash(still_open(placed(shared, None), range(0)), "members")
    pairs = stash(likely_across(open_, signed, close), "pairs")
    return confirmed(pairs, Sets(sets_of))


def report(documents: DataFrame, nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """documents(doc_id, n_shingles, node, ..) with root and component_id, the least doc_id of their component.

    nodes: node, rep (the least doc_id), times. Components are settled on classes; documents only look up their own class,
    by a join that is split for classes of very many copies. Documents without a node are alone.
    """
    named = nodes.select("node", "times", F.col("node").alias("root"), F.col("rep").alias("component_id"))
    if roots is not None:
        by_root = stash(nodes.select("node", "times", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
        of_root = by_root.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("times"))
        found = split_join(by_root.select("node", "root", F.col("times").alias("copies")), of_root, ["root"], frequent_from(by_root.count()))
        named = stash(found.select("node", F.col("copies").alias("times"), "root", "component_id"), "named")
    some = split_join(documents.filter("node is not null"), named, ["node"], frequent_from(documents.count()))
    none = documents.filter("node is null").withColumn("root", F.col("node")).withColumn("component_id", F.col("doc_id"))
    return some.unionByName(none)
