"""Exact top-k inner products from an impact-ordered index, processed score-at-a-time.

Vectors are quantised to integers and dealt into shards of `shard_rows`. A shard's index holds, for
each dimension, its rows ordered by impact (the component) and cut into segments of equal length; a
segment's quantised impact is its lowest and highest component. A query takes segments in descending
order of what they can still add, in rounds, and adds each segment's lowest and highest contribution
to its rows' two accumulators. After a round a row can reach at most its upper sum and what is left
to gain, and the k-th highest lower sum is certain. Processing stops only on that proof, when the possible members
are few or nothing is left, and the possible members are rescored exactly. The answer is exact
whatever the segments' width; the width only decides how many rows are rescored.

Each shard's rows go to one task, followed by the queries: rows and queries are dealt out by shard and
sorted so that a task reads a shard's rows, builds its index once, and then streams the queries through
it in Arrow batches. What is shuffled is every row once and every query once per shard. No row of a query
is ever paired with a row of the table; a shard returns its own k best, which are merged by a partial
aggregation. A query starts with what it is sure of already: the k best scores against the first rows
of each shard.

Cases: vectors that are null or hold null or non-finite components take no part, neither as query
nor as candidate; a shorter vector counts as padded with zeros; a null id is no query and never a
candidate; rows with the query's id are left out only where they are the query's own row, that is
one row for each repeat; with fewer rows than k all are returned; an empty table gives an empty
result. Scores are exact integers: sums stay below 2**53 in doubles, and a row whose scaled components are
too large for that is scored in whole numbers of any size, one by one, as query and as candidate; a score
beyond a long is returned as the nearest long, and rows with that one score rank by vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stash

SHARD_ROWS, SEGMENTS = 16384, 64
SCALE = 256
#: First rows of a shard that give a query its first sure scores.
FIRST = 256
_LONG = np.iinfo(np.int64)
#: Stop when at most this share of the shard can still be members; asked after each round of so many segments.
FEW, ROUND = 0.002, 512


class ImpactIndex:
    """Postings of one shard: per dimension, rows in order of impact, cut into segments of equal length."""

    def __init__(self, vectors: np.ndarray, segments: int = SEGMENTS):
        self.vectors = vectors.astype(np.float64)  # integers; all products and sums stay below 2**53
        self.segments = self.read = 0  # segments of the shard, and segments processed, over all searches
        n, dims = vectors.shape
        segments = max(1, min(segments, n))
        width = -(-n // segments)
        segments = -(-n // width)
        order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        ranked = np.take_along_axis(self.vectors.T, order, axis=1)
        first = np.arange(segments) * width
        self.low = ranked[:, first]
        self.high = ranked[:, np.minimum(first + width, n) - 1]
        # One row per segment; the last of a dimension is filled up with row n, which counts for nothing.
        self.postings = np.full((dims, segments * width), n, np.int32)
        self.postings[:, :n] = order
        self.postings = self.postings.reshape(dims * segments, width)

    def search(self, query: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best (ties all included beyond k), without row skip."""
        n = len(self.vectors)
        q = query.astype(np.float64)
        rows = np.arange(n)
        self.segments += len(self.postings)
        if n > 8 * k and q.any():
            one, two = q[:, None] * self.low, q[:, None] * self.high
            sure, best = np.minimum(one, two), np.maximum(one, two)
            floor = sure.min(axis=1)
            live = np.flatnonzero((best > floor[:, None]).ravel())  # the others add nothing to any row
            order = live[np.argsort(-(best - floor[:, None]).ravel()[live], kind="stable")]
            lower = np.full(n + 1, floor.sum())
            upper = lower.copy()
            gain, most = (sure - floor[:, None]).ravel(), (best - floor[:, None]).ravel()
            dim, width = order // best.shape[1], self.postings.shape[1]
            known = self.vectors[:FIRST] @ q
            if skip < FIRST and skip >= 0:
                known = np.delete(known, skip)
            known = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf
            for at in range(0, len(order), ROUND):
                now = order[at : at + ROUND]
                self.read += len(now)
                to = self.postings[now].ravel()
                lower += np.bincount(to, np.repeat(gain[now], width), n + 1)
                upper += np.bincount(to, np.repeat(most[now], width), n + 1)
                # What a row that a dimension has not met yet can still get from it.
                left = np.zeros(len(q))
                np.maximum.at(left, dim[at + ROUND :], most[order[at + ROUND :]])
                sures = lower[:n] if skip < 0 else np.delete(lower[:n], skip)
                kth = max(known, np.partition(sures, len(sures) - k)[len(sures) - k])
                rows = np.flatnonzero(upper[:n] + left.sum() >= kth)
                if len(rows) <= max(4 * k, FEW * n):
                    break
        rows = rows[rows != skip]
        scores = self.vectors[rows] @ q
        if len(rows) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[keep], scores[keep]
        return rows, scores.astype(np.int64)


def _fits(x: np.ndarray) -> bool:
    """Whether the products of two such rows sum up exactly in doubles."""
    return len(x) == 0 or np.abs(x).max() < min((2.0**53 / len(x)) ** 0.5, 2.0**31)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integer components as bytes, int32 or, where they do not fit, as wide doubles; rows that take no part are left out."""
    for batch in batches:
        ids, rows, out, wide = [], [], [], []
        for i, r, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                y = np.floor(SCALE * x)
            fits = _fits(y)
            ids.append(i)
            rows.append(r)
            wide.append(not fits)
            out.append((y.astype(np.int32) if fits else x).tobytes())
        columns = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(out, pa.binary()), pa.array(wide, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "row", "v", "wide"])


def _matrix(parts: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(parts), dims), np.int32)
    for i, v in enumerate(parts):
        x = np.frombuffer(v, np.int32)
        out[i, : len(x)] = x
    return out


def _whole(v: bytes, wide: bool) -> list[int]:
    """Components as Python's whole numbers; a wide row keeps its doubles, as their multiple may be beyond a double."""
    if not wide:
        return np.frombuffer(v, np.int32).tolist()
    return [(SCALE * a) // b for a, b in (x.as_integer_ratio() for x in np.frombuffer(v, np.float64).tolist())]


class _Shard:
    """A shard's rows and, once all are there, their index."""

    def __init__(self, number: int):
        self.number, self.rows = number, []
        self.index = None

    def built(self) -> None:
        fits = [r for r in self.rows if not r[3]]
        self.wide = [(r[0], r[1], _whole(r[2], True)) for r in self.rows if r[3]]
        self.dims = max([1, *(len(r[2]) // 4 for r in fits)])
        self.index = ImpactIndex(_matrix([r[2] for r in fits], self.dims)) if fits else None
        self.vec_ids = np.array([r[0] for r in fits], np.int64)
        self.row_of = [r[1] for r in fits]
        self.place = {r: i for i, r in enumerate(self.row_of)}
        self.parts, self.rows = [r[2] for r in fits], None

    def best(self, vec_id: int, row: int, v: bytes, wide: bool, k: int) -> list[tuple[int, int]]:
        """vec_id and score of the k best, without the query's own row."""
        found: list[tuple[int, int]] = []
        if self.index is not None and not wide:
            q = np.zeros(max(self.dims, len(v) // 4))
            q[: len(v) // 4] = np.frombuffer(v, np.int32)
            at, score = self.index.search(q[: self.dims], k, self.place.get(row, -1))
            top = np.lexsort((self.vec_ids[at], -score))[:k]
            found = list(zip(self.vec_ids[at[top]].tolist(), score[top].tolist()))
        if wide or self.wide:
            own = _whole(v, wide)
            score_of = lambda x: min(max(sum(a * b for a, b in zip(own, x)), _LONG.min), _LONG.max)
            found += [(i, score_of(x)) for i, r, x in self.wide if r != row]
            if wide:
                found += [(int(i), score_of(_whole(p, False))) for i, r, p in zip(self.vec_ids, self.row_of, self.parts) if r != row]
            found = sorted(found, key=lambda f: (-f[1], f[0]))[:k]
        return found


_FOUND = "query_id long, query_row long, vec_id long, score long"


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for shard, asks, vec_id, row, v, wide in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now.number != shard:
                    now = _Shard(shard)
                if not asks:
                    now.rows.append((vec_id, row, v, wide))
                    continue
                if now.rows is not None:
                    now.built()
                best = now.best(vec_id, row, v, wide, k)
                out += [(vec_id, row, i, s) for i, s in best]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in _FOUND.split(", ")])

    return search


def top_k(vectors: DataFrame, k: int = 5, query_step: int = 50, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by query_step."""
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col("embedding").cast("array<double>").alias("embedding"))
    packed = stash(slim.mapInArrow(_packed, "vec_id long, row long, v binary, wide boolean"), "packed")
    shards = max(1, -(-packed.count() // shard_rows))
    columns = ["shard", "asks", "vec_id", "row", "v", "wide"]
    held = packed.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("asks", F.lit(False))
    asked = (
        packed.filter(F.col("vec_id") % query_step == 0)
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))
    )
    dealt = held.select(columns).unionByName(asked.select(columns)).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(_searcher(k), _FOUND)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
