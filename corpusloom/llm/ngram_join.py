"""Jaccard join of shingle sets at 0.8 by PartEnum signatures.

Set sizes fall into bands. Two linked sets of one band, or of neighbouring bands, differ in at most k shingles, with k
from the band's largest sizes; both sides of each such case write signatures under one tag. The domain of shingle
hashes is cut into n1 parts and each part into n2 cells. With n1 = floor(k / (k2 + 1)) + 1 + spare parts, two linked sets differ
in at most k2 shingles in more than `spare` parts; in such a part at least n2 - k2 cells agree, so of the signatures
of all subsets of n2 - k2 cells one is shared. Classes of equal sets are settled before and share no work.

A signature of empty cells would be shared by sets that have nothing in common. A set that has such in no more than
`spare` parts leaves them out: of the parts in which it agrees with a partner one is left without any. A set that has more
(a thin one) leaves them out too, but both of a pair may do so; thin sets of a tag therefore also write the
first shingles of their set in hash order, as many as any two linked sets must share one of. So no pair is lost.

Candidates, links and components: near_links.py. The cheap test is exact: the parities of 1,024 cells of the domain
differ in at most as many places as the sets differ in shingles. Large sets, which nearly all pass that, are told apart by more cells.

Cases: null or blank text has an empty set and is linked with nothing; a text of fewer words than a shingle has its whole
sequence as the only one; equal sets are one class whatever their number; a null doc_id is a component's id only where there is
no other; repeated doc_ids count as rows each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm import near_links as N
from corpusloom.llm.common import drop_shuffles, small_batches, stash
from corpusloom.llm.minhash import WORDS, full_sets, shingle_sets
from corpusloom.llm.near_links import PER_CENT, set_digest

#: A band's largest size is at most so many times its least; share of spare parts.
BAND, SPARE = 1.6, 0.15
#: Longs of parities of a set.
PARITY = 16
#: Larger sets have so many cells in fewer shingles that almost any two pass; parities of this many cells a shingle tell them apart.
WIDE = 2
#: Classes of which a task remembers that it has written their keys; it saves rows, no result rests on it.
REMEMBERED = 1 << 17


def bands(upto: int = 1 << 40) -> list[tuple[int, int]]:
    """The least and the largest size of each band."""
    out, low = [], 1
    while low <= upto:
        out.append((low, max(low, int(low * BAND))))
        low = out[-1][1] + 1
    return out


BANDS = bands()
_LOWS = np.array([low for low, _ in BANDS])


def differing(one: int, two: int) -> int:
    """The most shingles in which linked sets of at most these sizes differ."""
    return (one + two) * (100 - PER_CENT) // (100 + PER_CENT)


class Scheme:
    """Parts, cells and their subsets for a tag whose sets differ in at most k shingles."""

    def __init__(self, tag: int, k: int):
        if k <= 2:
            self.k2, self.n2, self.spare = k, 6, 0
        elif k <= 24:
            self.k2, self.n2, self.spare = 2, 4, 1
        else:
            self.k2, self.n2, self.spare = 1, 2, int(np.ceil((k // 2 + 1) * SPARE))
        self.n1 = k // (self.k2 + 1) + 1 + self.spare
        chosen = list(itertools.combinations(range(self.n2), self.n2 - self.k2))
        self.subsets = np.zeros((self.n2, len(chosen)), np.uint64)
        for j, cells in enumerate(chosen):
            self.subsets[list(cells), j] = 1
        self.counts = self.subsets.astype(np.int64)
        names = np.arange(self.n1 * len(chosen), dtype=np.uint64).reshape(self.n1, -1)
        number = np.array([tag + 1], np.uint64)
        self.names = K.mix(names + number * np.uint64(0x9E3779B97F4A7C15))
        self.first = K.mix(number * np.uint64(0xA0761D6478BD642F))

    def keys(self, hashes: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """The keys of a sorted set; upto: running sums over its shingles, by which cells are told apart."""
        cells = self.n1 * self.n2
        cell = ((hashes >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
        held = np.bincount(cell.view(np.int64), minlength=cells)
        ends = np.zeros(cells + 1, np.int64)
        np.cumsum(held, out=ends[1:])
        at = upto[ends]
        content, held = (at[1:] - at[:-1]).reshape(self.n1, self.n2), held.reshape(self.n1, self.n2)
        if self.n2 - self.k2 > 1:
            content, held = content @ self.subsets, held @ self.counts
        full = held > 0
        keys = K.mix(content + self.names)
        if full.all():
            return keys.ravel()
        keys = keys[full]
        if (~full).any(axis=1).sum() > self.spare:
            size = len(hashes)
            keys = np.append(keys, K.mix(hashes[: size - -(-size * PER_CENT // 100) + 1] + self.first))
        return keys


class Schemes:
    """The schemes that sets of each size take part in, made when first asked for."""

    def __init__(self):
        self.of: dict[int, Scheme | None] = {}

    def _get(self, tag: int, k: int) -> Scheme | None:
        if tag not in self.of:
            self.of[tag] = Scheme(tag, k) if k else None  # sets that may not differ are one class
        return self.of[tag]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        size = len(hashes)
        band = int(np.searchsorted(_LOWS, size, side="right")) - 1
        found = [self._get(2 * band, differing(BANDS[band][1], BANDS[band][1]))]
        for below in (band - 1, band):  # the tag of two neighbouring bands, for sets that may have a partner in the other
            if below < 0:
                continue
            small, low = BANDS[below][1], BANDS[below + 1][0]
            large = min(BANDS[below + 1][1], small * 100 // PER_CENT)
            if low * PER_CENT <= size * 100 and size <= large:
                found.append(self._get(2 * below + 1, differing(small, large)))
        upto = np.zeros(size + 1, np.uint64)
        np.cumsum(K.mix(hashes + np.uint64(3)), out=upto[1:])
        return np.concatenate([np.empty(0, np.uint64), *(s.keys(hashes, upto) for s in found if s is not None)])


def parities(hashes: np.ndarray, longs: int = PARITY) -> np.ndarray:
    """Whether each cell of the domain, of 64 to a long, holds an odd number of the set, packed."""
    odd = np.bincount((hashes & np.uint64(longs * 64 - 1)).astype(np.int64), minlength=longs * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parities(hashes: np.ndarray) -> np.ndarray | None:
    """Parities of WIDE cells a shingle or more, a power of two; None where parities() has as many."""
    longs = 1 << max(0, (-(-len(hashes) * WIDE // 64) - 1).bit_length())
    return parities(hashes, longs) if longs > PARITY else None


def _close() -> Column:
    """No linked pair fails: sizes are similar, and parities differ in no more places than linked sets may differ in shingles."""
    apart = None
    for k in range(PARITY):
        n = F.bit_count(F.col("x.sig")[k].bitwiseXOR(F.col("y.sig")[k]))
        apart = n if apart is None else apart + n
    both = F.col("x.size") + F.col("y.size")
    return N.similar_sizes(F.col("x.size"), F.col("y.size")) & (apart * (100 + PER_CENT) <= both * (100 - PER_CENT))


def _close_wide() -> Column:
    """The same by wide_parities(). Those of a set of up to 1.25 times the size have as many cells or twice as many, and then two of them make one."""
    x, y = F.col("x.wide"), F.col("y.wide")
    n = F.least(F.size(x), F.size(y))
    folded = lambda w: F.when(F.size(w) == n, w).otherwise(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, n + 1, n), lambda a, b: a.bitwiseXOR(b)))
    apart = F.aggregate(F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, k: total + k)
    both = F.col("x.size") + F.col("y.size")
    return x.isNull() | y.isNull() | (apart * (100 + PER_CENT) <= both * (100 - PER_CENT))


_SIGNED = "doc_id {id}, n_shingles long, node binary, short long, sig array<long>, wide array<long>"


def _short(node: bytes) -> int:
    """The first 64 bits of a node, which stand for it beside its keys; linked classes differ in them but for a chance of 2**-64."""
    return int.from_bytes(node[:8], "little", signed=True)


def _signed(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, short, sig, wide = [], [], [], [], []
            for s in shingle_sets(K.column_bytes(batch, "text"), words):
                n.append(len(s))
                node.append(set_digest(s) if len(s) else None)
                short.append(_short(node[-1]) if len(s) else None)
                sig.append(parities(s) if len(s) else None)
                wide.append(wide_parities(s))
            longs = pa.list_(pa.int64())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(short, pa.int64()), pa.array(sig, longs), pa.array(wide, longs)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "node", "short", "sig", "wide"])

    return sign


def _keyed(words: int):
    """key, short: each class's keys with the first 64 bits of its node, once a task as far as it remembers."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, seen = Schemes(), set()
        for batch in batches:
            keys, short = [], []
            for s in shingle_sets(K.column_bytes(batch, "text"), words):
                node = set_digest(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                keys.append(schemes.keys(s).view(np.int64))
                short.append(np.full(len(keys[-1]), _short(node)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(short))], ["key", "short"])

    return keyed


def signatures(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed documents, their classes (node, rep, times, size, sig, wide) and key, node of the keys that several classes have, equal keys merged."""
    small_batches(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    signed = stash(slim.mapInArrow(_signed(words), _SIGNED.format(id=docs.schema["doc_id"].dataType.simpleString())), "signed")
    nodes = stash(
        signed.filter("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("times"), F.first("short").alias("short"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("wide").alias("wide")
        ),
        "nodes",
    )
    # A class has hundreds of keys, so even the members of a key that a third of all classes have are a small share of the rows.
    of_key = Window.partitionBy("key")
    rows = docs.select("text").mapInArrow(_keyed(words), "key long, short long")
    shared = rows.select("key", "short", F.min("short").over(of_key).alias("lo"), F.max("short").over(of_key).alias("hi")).filter("lo < hi")
    shared = shared.select("key", "short").distinct()
    # As near_links.merged() does, within the shuffle that there is: one key for all that the same classes have.
    shared = stash(shared.select(F.bit_xor(F.xxhash64("short")).over(of_key).alias("key"), "short").distinct(), "shared")
    drop_shuffles(docs.sparkSession)
    named = stash(shared.join(nodes.select("node", "short"), "short").select("key", "node"), "members")
    return signed, nodes, named


def links(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """The join itself: (doc_id, n_shingles, node) of every document and (u, v) of every two linked classes, each pair once.

    Documents of one node have equal sets. As many rows as there are linked pairs of different sets, so for groups of
    many near copies report() is the smaller answer.
    """
    signed, nodes, shared = signatures(docs, words)
    found = N.all_links(shared, nodes.select("node", "size", "sig"), _close(), lambda wanted: full_sets(wanted, nodes, docs.select("doc_id", "text"), words))
    return signed.select("doc_id", "n_shingles", "node"), found.select("u", "v")


def report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    signed, nodes, shared = signatures(docs, words)
    slim = docs.select("doc_id", "text")
    roots = N.components(shared, nodes.select("node", "size", "sig"), _close(), lambda wanted: full_sets(wanted, nodes, slim, words), many_keys=True, finer=(nodes.select("node", "size", "wide"), _close_wide()))
    return N.report(signed.select("doc_id", "n_shingles", "node"), nodes, roots).select("doc_id", "n_shingles", "component_id")
