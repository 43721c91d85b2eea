"""Removal of long repeated byte strings by suffix arrays of shards.

Every window of 400 bytes names an anchor by its own content: the position of the least hash among
its 100-byte grams, leftmost on ties. Equal windows therefore have equal anchor hashes, and a run of
windows with one anchor is a segment of a text. Segments go to shards by anchor hash, so equal
windows meet in one shard wherever they stand, and a window in one segment is never the same
occurrence as a window in another. A shard's distinct segments are joined into one text whose suffix
array is built by induced sorting (suffix_array.py); permuted common prefixes of 400 or more mark
the repeated windows. Anchors that occur once are dropped before, and identical segments are counted
rather than sent twice, which is all that copies of whole documents need.

Joins on anchors and contents are split: keys that hold a thousandth of all segments or more are
broadcast (a thousand rows at most, each with runs of a segment of some 300 windows), so copies by the
million do not meet in one task.

An anchor with more than `hot` distinct segments (a passage that very many texts share, cut at
different neighbours) is left out of the shards: its windows are hashed one by one and counted with
map-side combination, so no task ever holds such a group.

Cases: null and empty texts have nothing to remove; texts below 400 bytes neither; matches never
cross documents; overlapping repeats within one text count; identical rows repeat each other; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm.common import frequent_from, fresh, small_batches, split_join, stash, text_or_empty, whole_row
from corpusloom.llm.suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 400, 100
#: Bytes of a shard's text, and distinct segments of one anchor that a shard may get.
SHARD_BYTES, HOT = 2_000_000, 2048
#: Texts are cut into overlapping pieces of so many windows, which breaks segments but loses no window.
PIECE = 1 << 22

_POS = np.uint64((1 << 24) - 1)


def _window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive keys."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """index of the text, offset, bytes: whole texts, or overlapping pieces of giant ones."""
    for i, t in enumerate(texts):
        if len(t) >= LENGTH:
            for at in range(0, len(t) - LENGTH + 1, PIECE):
                yield i, at, t[at : at + PIECE + LENGTH - 1]


def segments(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of text index, anchor hash, content hash, start and number of windows of each segment."""
    parts = list(_pieces([t or b"" for t in texts]))
    for first, held in K.blocks([p[2] for p in parts]):
        data, at = K.joined(held)
        prefix = K.prefix_hash(data)
        gram = np.arange(len(data) - GRAM + 1)
        h = K.span_hash(prefix, gram, gram + GRAM)
        least = _window_minima((h & ~_POS) | gram.astype(np.uint64), LENGTH - GRAM + 1)
        own = np.repeat(np.arange(len(held)), np.diff(at))[: len(least)]
        inside = np.arange(len(least)) + LENGTH < at[own + 1]  # the separator is in no window
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(change)
        end = np.append(start[1:], len(least))
        keep = inside[start]
        start, end = start[keep], end[keep]
        doc = own[start]
        where = np.array([parts[first + i][0] for i in range(len(held))])
        shift = np.array([parts[first + i][1] for i in range(len(held))])
        content = K.span_hash(prefix, start, end - 1 + LENGTH)
        anchor = least[start] & ~_POS
        yield where[doc], K.mix(anchor).view(np.int64), content.view(np.int64), start - at[doc] + shift[doc], end - start


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, anchor, content, start, n in segments(K.column_bytes(batch, "text")):
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor), pa.array(content), pa.array(start, pa.int64()), pa.array(n, pa.int64())],
                ["doc_id", "digest", "anchor", "content", "start", "n"],
            )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that are asked of each text."""
    for batch in batches:
        asked = batch.column(1)
        for t, want in zip(K.column_bytes(batch, "text"), asked):
            rows = want.values
            anchor, content, start, n = (rows.field(k).to_numpy() for k in ("anchor", "content", "start", "n"))
            cut = [t[a : a + m + LENGTH - 1] for a, m in zip(start.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), pa.array(cut, pa.binary())], ["anchor", "content", "bytes"])


_RUNS = "anchor long, content long, a long, b long"


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeated_in(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """part, first and one past the last start of the runs of windows that occur again in parts."""
    size = np.array([len(p) for p in parts], np.int64)
    at = np.append(0, np.cumsum(size + 1))
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int16) + np.int16(1)
    text[at[1:] - 1] = 0
    prefix, phi = common_prefixes(text, suffix_array(text, 257), length)
    hit = np.flatnonzero(prefix >= length)
    marked = np.zeros(len(text), bool)
    marked[hit] = True
    marked[phi[hit]] = True
    for p, n in zip(at[1:], size):  # a window that would hold a separator
        marked[max(p - 1 - min(n, length - 1), 0) : p] = False
    a, b = _runs(marked)
    part = np.searchsorted(at, a, side="right") - 1
    return part, a - at[part], b - at[part]


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    part, a, b = repeated_in(rows["bytes"].tolist())
    return pd.DataFrame({"anchor": rows["anchor"].to_numpy()[part], "content": rows["content"].to_numpy()[part], "a": a, "b": b})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of hot anchors' segments on a row of its own."""
    for batch in batches:
        anchor, content = (batch.column(k).to_numpy() for k in (0, 1))
        for c, h, t in zip(anchor, content, K.column_bytes(batch, "bytes")):
            data = np.frombuffer(t, np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            window = K.span_hash(K.prefix_hash(data), at, at + LENGTH).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), c)), pa.array(np.full(len(at), h)), pa.array(at, pa.int64()), pa.array(window)],
                ["anchor", "content", "a", "window"],
            )


def digest_of(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """digest, spans: the byte spans of each distinct text that hold strings which occur elsewhere too."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tagged = docs.select("doc_id", digest_of(text_or_empty()).alias("digest"), "text")
    long_enough = tagged.filter(F.octet_length("text") >= LENGTH)
    rows = stash(
        long_enough.mapInArrow(_anchored, f"doc_id {id_type}, digest binary, anchor long, content long, start long, n long"), "segments"
    )
    least = frequent_from(rows.count())
    counts = stash(
        rows.groupBy("anchor").agg(F.count("*").alias("times"), F.min("content").alias("lo"), F.max("content").alias("hi")).filter("times > 1")
        .select("anchor", "times", (F.col("lo") != F.col("hi")).alias("differ")),
        "anchors",
    )
    again = stash(split_join(rows, counts, ["anchor"], least), "again")
    alike = again.filter("not differ")
    differ = again.filter("differ").drop("differ")
    distinct = stash(
        differ.groupBy("anchor", "content").agg(
            F.count("*").alias("times"), F.expr("min(struct(digest, doc_id is null as no_id, doc_id, start, n)) as first")
        ),
        "distinct",
    )
    # The bytes of one occurrence of each distinct segment.
    asked = distinct.groupBy(F.col("first.digest").alias("digest"), F.col("first.doc_id").alias("_id")).agg(
        F.collect_list(F.struct("anchor", "content", "first.start", "first.n")).alias("asked")
    )
    meets = (F.col("t.digest") == F.col("q.digest")) & F.col("t.doc_id").eqNullSafe(F.col("q._id"))
    cut = stash(
        long_enough.alias("t")
        .join(asked.alias("q"), meets)
        .select("t.text", "q.asked")
        .mapInArrow(_cut_out, "anchor long, content long, bytes binary")
        .dropDuplicates(["anchor", "content"]),
        "cut",
    )
    sizes = cut.groupBy("anchor").agg(F.count("*").alias("segments"))
    crowded = sizes.filter(F.col("segments") > hot).select("anchor")
    total = cut.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, total // SHARD_BYTES)
    calm = cut.join(crowded, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = calm.groupBy("shard").applyInPandas(_shard, _RUNS)
    if not crowded.isEmpty():
        windows = cut.join(crowded, "anchor", "left_semi").mapInArrow(_windows, "anchor long, content long, a long, window long")
        twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
        singles = windows.join(twice, ["anchor", "window"], "left_semi")
        found = found.unionByName(singles.select("anchor", "content", "a", (F.col("a") + 1).alias("b")))
    once = F.lit(1).cast("long")
    found = stash(
        found.withColumn("times", once).unionByName(
            distinct.filter("times > 1").select("anchor", "content", F.lit(0).cast("long").alias("a"), F.col("first.n").alias("b"), "times")
        ).groupBy("anchor", "content").agg(F.collect_set(F.struct("a", "b")).alias("runs"), F.max("times").alias("times")),
        "runs",
    )
    spans = (
        split_join(differ, found, ["anchor", "content"], least)
        .select("digest", "start", F.explode("runs").alias("r"))
        .select("digest", (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") - 1 + LENGTH).alias("b"))
        .unionByName(alike.select("digest", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + LENGTH).alias("b")))
    )
    return spans.groupBy("digest").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def cut_spans(t: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """t without the spans (rows of start and end), the number of bytes gone and of maximal runs."""
    if not len(spans):
        return t, 0, 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > end[:-1])
    first = np.flatnonzero(new)
    a, b = spans[first, 0].tolist(), end[np.append(first[1:] - 1, len(end) - 1)].tolist()
    kept = b"".join(t[p:q] for p, q in zip([0, *b], [*a, len(t)]))
    return kept, len(t) - len(kept), len(a)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, gone, runs, sha = [], [], [], []
        for t, spans in zip(K.column_bytes(batch, "text"), batch.column(2)):
            t = t or b""
            at = np.empty((0, 2), np.int64)
            if spans.is_valid:
                at = np.stack([spans.values.field(k).to_numpy() for k in ("a", "b")], axis=1)
            kept, n, m = cut_spans(t, at)
            size.append(len(t))
            gone.append(n)
            runs.append(m)
            sha.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(sha, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = None
    for batch in batches:
        at = batch.schema.get_field_index("text") if at is None else at
        out = []
        for t, spans in zip(K.column_bytes(batch, "text"), batch.column(batch.num_columns - 1)):
            if t is not None and spans.is_valid:
                t = cut_spans(t, np.stack([spans.values.field(k).to_numpy() for k in ("a", "b")], axis=1))[0]
            out.append(t if t is None else t.decode("utf-8", "ignore"))
        columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs and, as the last column, the spans to cut from each text."""
    last = fresh("spans", docs.columns)
    spans = stash(repeats(docs.select("doc_id", "text")), "spans").select(F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))
    tagged = docs.select(whole_row(docs).alias("doc"), digest_of(text_or_empty()).alias("_digest"))
    return tagged.join(spans, "_digest", "left").select("doc.*", F.col("_spans").alias(last))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_spans(docs.select("doc_id", "text")).mapInArrow(_report, out)


def remove(docs: DataFrame) -> DataFrame:
    """docs with the repeated strings cut from their texts; a character cut in two goes whole."""
    return _with_spans(docs).mapInArrow(_kept, docs.schema)
