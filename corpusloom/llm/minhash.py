"""Near-dedup by b-bit MinHash with banding, confirmed on full shingle sets, and connected components.

One pass over the texts makes each document's set of distinct n-word shingles (64-bit hashes; five
words unless the caller asks for another number), 224 minima, of which 2 bits each are kept and packed
into 7 longs, and 37 keys of 6 minima each. Documents with equal sets are one class from then on, so
copies never meet each other. Classes that share a band key are candidates (near_links.py: stars, then
members of different components); the packed signatures give a collision-corrected estimate by bit
counts, and what could reach the threshold is confirmed on the full sets. Small sets, whose estimates
are coarse, are confirmed without one.

A pair of similarity 0.8 shares no key with a probability of 1.3e-5 (0.85: 1e-8).

Cases: null or blank text has an empty set (n_shingles 0) and is linked with nothing; a text of one
word has that word as its only shingle; equal texts are one class whatever their number; a null doc_id
is never a component's id unless its component has no other; rows with equal ids share their flags; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm import near_links as N
from corpusloom.llm.common import small_batches, stash, text_or_empty, whole_row
from corpusloom.llm.near_links import PER_CENT, set_digest

MINIMA, ROWS, BANDS, LOW_BITS = 224, 6, 37, 2
#: Estimates are let through 4.4 deviations below the threshold, and sets of fewer shingles are confirmed without one.
SLACK, SMALL = 0.14, 64
#: Words of a shingle where no contract says otherwise.
WORDS = 5

_RNG = np.random.default_rng(1709)
_A = (_RNG.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32)[:, None]


def shingle_sets(texts: list[bytes | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of n-word shingles of each text, letters A-Z lower-cased."""
    for _, held in K.blocks(texts):
        data, at = K.joined(held)
        data = K.LOWER[data]
        start, end = K.words(data)
        word = K.span_hash(K.prefix_hash(data), start, end)
        cut = np.searchsorted(start, at)
        run = word.copy()
        for k in range(1, n):
            run = K.mix(run[: len(word) - k] * np.uint64(0xD1342543DE82EF95) + word[k:] + np.uint64(k))
        for i in range(len(held)):
            a, b = cut[i], cut[i + 1]
            if b - a >= n:
                own = np.sort(run[a : b - n + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif b > a:  # fewer words than n: the whole sequence is one
                whole = word[a : a + 1]
                for k in range(1, b - a):
                    whole = K.mix(whole * np.uint64(0xD1342543DE82EF95) + word[a + k : a + k + 1] + np.uint64(k))
                yield K.mix(whole + np.array([b - a], np.uint64) * np.uint64(0xA0761D6478BD642F))
            else:
                yield np.empty(0, np.uint64)


def _minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, x.shape[1], 1024):
        np.minimum(low, (x[:, k : k + 1024] * _A + _B).min(axis=1), out=low)
    return low


_SHIFT = (np.arange(32, dtype=np.uint64) * np.uint64(LOW_BITS))[None, :]
_BAND_NO = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x8CB92BA72F3D8DD7)


def _signature(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed bits, and the band keys, which carry their band's number.

    Minima are mixed first: the low bits of a minimum itself depend on the low bits of its shingle alone.
    """
    bits = (K.mix(low.astype(np.uint64)) & np.uint64(2**LOW_BITS - 1)).reshape(-1, 32)
    packed = np.bitwise_or.reduce(bits << _SHIFT, axis=1)
    keys = _BAND_NO.copy()
    rows = low[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        keys = K.mix(keys + rows[:, k])
    return packed.view(np.int64), keys.view(np.int64)


_SIGNED = "doc_id {id}, digest binary, n_shingles long, node binary, sig array<long>, keys array<long>"


def _signed(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, sigs, keys = [], [], [], []
            for s in shingle_sets(K.column_bytes(batch, "text"), words):
                n.append(len(s))
                sig, key = _signature(_minima(s)) if len(s) else (None, None)
                node.append(set_digest(s) if len(s) else None)
                sigs.append(sig)
                keys.append(key)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (sigs, keys)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), *lists],
                ["doc_id", "digest", "n_shingles", "node", "sig", "keys"],
            )

    return sign


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_node = {set_digest(s): s for s in shingle_sets(K.column_bytes(batch, "text"), words)}
            ids, made = pa.array(list(by_node), pa.binary()), list(by_node.values())
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))], ["node", "hashes"])

    return sets


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, hashes: the full sets of the wanted classes, made anew from one document of each."""
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("rep").alias("_rep")).distinct()
    needed = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    return needed.select("text").mapInArrow(_sets(words), "node binary, hashes array<long>").dropDuplicates(["node"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal low bits, corrected for chance agreement."""
    odd = F.lit(0x5555555555555555)
    differ = None
    for k in range(MINIMA // 32):
        x = a[k].bitwiseXOR(b[k])
        count = F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(odd))
        differ = count if differ is None else differ + count
    chance = 1.0 / 2**LOW_BITS
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def _close(least: float) -> Column:
    """Whether x and y may be linked, by their sizes and signatures."""
    small = F.least("x.size", "y.size") < SMALL
    return N.similar_sizes(F.col("x.size"), F.col("y.size")) & (small | (estimate(F.col("x.sig"), F.col("y.sig")) >= least))


def links(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The signed documents, their classes (node, rep, times, ..) and node, root of the classes' components (None: no two are linked)."""
    small_batches(docs.sparkSession)
    slim = docs.select("doc_id", F.unhex(F.md5(text_or_empty().cast("binary"))).alias("digest"), "text")
    signed = stash(slim.mapInArrow(_signed(words), _SIGNED.format(id=docs.schema["doc_id"].dataType.simpleString())), "signed")
    nodes = stash(
        signed.filter("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("times"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("keys").alias("keys")
        ),
        "nodes",
    )
    members = nodes.select("node", F.explode("keys").alias("key"))
    often = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    shared = stash(N.merged(stash(members.join(often, "key", "left_semi"), "shared")), "merged")
    roots = N.components(shared, nodes.select("node", "size", "sig"), _close(PER_CENT / 100 - SLACK), lambda wanted: full_sets(wanted, nodes, slim, words))
    return signed, nodes, roots


def report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    out = N.report(*_found(docs, words))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _found(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    signed, nodes, roots = links(docs, words)
    return signed.select("doc_id", "digest", "n_shingles", "node"), nodes, roots


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with one document of each component, columns unchanged; rows without any word stay.

    The smallest doc_id stays, with all rows that have it; where a component has null ids only, the text of the least
    digest, with all rows equal to it.
    """
    found = N.report(*_found(docs, words)).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = found.filter("doc_id is not null").select(F.col("doc_id").alias("_id"), F.lit(None).cast("binary").alias("_digest"))
    nameless = found.filter("doc_id is null")
    wordless = nameless.filter("node is null").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    least = nameless.filter("node is not null").groupBy("root").agg(F.min("digest").alias("_digest"))
    kept = named.unionByName(wordless).unionByName(least.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("_id"), "_digest")).distinct()
    rows = docs.select(whole_row(docs).alias("doc"), F.col("doc_id").alias("_key"), F.unhex(F.md5(text_or_empty().cast("binary"))).alias("_text"))
    same = F.col("_key").eqNullSafe(F.col("_id")) & F.when(F.col("_key").isNull(), F.col("_text")).eqNullSafe(F.col("_digest"))
    return rows.join(kept, same, "left_semi").select("doc.*")
