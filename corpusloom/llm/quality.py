"""Quality classifier: random Fourier features, ridge scores from summed normal equations, isotonic calibration.

One pass over the whole texts turns each into a few statistics (character classes, words, lines,
repetition), stored in the shared folder. Scale and centre come from all rows that may be learned
from. Random Fourier features approximate a Gaussian kernel over the scaled statistics; each
partition sums its share of the normal equations for each of five parts of the rows, the shares are
added up by matrix row, and only the summed matrices (five of FEATURES squared) reach the driver. The
sums without one part give the weights that score that part; those scores are binned and made
monotone by pooling adjacent violators, which turns the final weights' scores into probabilities.
The intercept is fitted apart from the kernel, so a text unlike all others gets the base rate.

Cases: null text counts as empty and gets a score like any other; labels that are null are not
learned from, several labels of one id are averaged; a null doc_id counts as empty text for the
fold; without a single label every score is 0.5; an empty table gives an empty result; only doc_id
and text are read, so no other column can reach a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm.common import fold_of, small_batches, stash

FEATURES, RIDGE, WIDTH = 256, 3e-4, 1.2
BINS, PARTS = 1000, 5

_CLASSES = {
    "letter": [*range(65, 91), *range(97, 123)],
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "space": [32],
    "line": [10],
    "stop": [44, 46, 59, 58, 63],
    "bang": [33],
    "bar": [124],
    "symbol": [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 126],
    "bracket": [34, 39, 40, 41, 91, 93, 123, 125],
    "high": [*range(128, 256)],
    "control": [*range(0, 9), *range(14, 32), 127],
}
_IN_CLASS = np.zeros((256, len(_CLASSES)))
for _j, _members in enumerate(_CLASSES.values()):
    _IN_CLASS[_members, _j] = 1.0
_IS_LETTER = (_IN_CLASS[:, 0] + _IN_CLASS[:, 10]) > 0
_IS_UPPER = _IN_CLASS[:, 1] > 0

STATISTICS = [f"share_{c}" for c in _CLASSES] + [
    "log_bytes", "log_words", "word_mean", "word_spread", "word_longest", "ends_in_symbol", "upper_words",
    "no_letter_words", "distinct_words", "common_word", "distinct_lines", "line_words", "byte_entropy",
]


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of STATISTICS for each text, made from the whole of it."""
    out = []
    for _, held in K.blocks(texts):
        data, at = K.joined(held)
        docs = len(held)
        size = np.diff(at) - 1
        own = np.repeat(np.arange(docs), np.diff(at))
        counts = np.bincount(own * 256 + data, minlength=docs * 256).reshape(docs, 256).astype(float)
        counts[:, 10] -= 1  # the separator
        some = np.maximum(size, 1)[:, None]
        shares = counts @ _IN_CLASS / some
        p = counts / some
        entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
        start, end = K.words(data)
        doc = own[start] if len(start) else np.empty(0, np.int64)
        n = np.bincount(doc, minlength=docs).astype(float)
        many = np.maximum(n, 1)
        length = (end - start).astype(float)

        def per_word(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, x, docs) / many  # noqa: B023

        mean = per_word(length)
        spread = np.sqrt(np.maximum(per_word(length**2) - mean**2, 0))
        longest = np.zeros(docs)
        np.maximum.at(longest, doc, length)
        letters = np.append(0, np.cumsum(_IS_LETTER[data]))
        uppers = np.append(0, np.cumsum(_IS_UPPER[data]))
        has = letters[end] - letters[start]
        up = uppers[end] - uppers[start]
        odd_end = (_IN_CLASS[data[end - 1], 8] + _IN_CLASS[data[end - 1], 6] + _IN_CLASS[data[end - 1], 7]) if len(end) else np.empty(0)
        prefix = K.prefix_hash(data)
        word = K.span_hash(prefix, start, end)
        order = np.lexsort((word, doc))
        new = np.ones(len(order), bool)
        new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        firsts = np.flatnonzero(new)
        distinct = np.bincount(doc[order][firsts], minlength=docs) / many
        common = np.zeros(docs)
        np.maximum.at(common, doc[order][firsts], np.diff(np.append(firsts, len(order))))
        breaks = np.flatnonzero(data == 10)
        from_ = np.append(0, breaks[:-1] + 1)
        line = K.span_hash(prefix, from_, breaks) ^ K.mix(own[breaks].astype(np.uint64))
        lines = np.bincount(own[breaks], minlength=docs)
        distinct_lines = np.bincount(own[breaks][np.unique(line, return_index=True)[1]], minlength=docs) / lines
        out.append(
            np.column_stack([
                np.sqrt(shares), np.log1p(size), np.log1p(n), mean, np.log1p(spread), np.log1p(longest), per_word(odd_end),
                per_word((up == has) & (has > 1)), per_word(has == 0), distinct, common / many, distinct_lines, np.log1p(n / lines), entropy,
            ])
        )
    return np.concatenate(out) if out else np.empty((0, len(STATISTICS)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(K.column_bytes(batch, "text"))
        rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows], [*batch.schema.names[:-1], "x"])


class Model:
    """Scaled statistics -> Fourier features -> ridge score -> calibrated probability."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = len(centre)
        self.centre, self.scale = centre, scale
        self.w = rng.standard_normal((d, FEATURES)) / (WIDTH * np.sqrt(d))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.ridge, self.base = np.zeros(FEATURES), 0.5
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -4, 4)
        return np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.features(x) @ self.ridge

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def _stacked(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.values.to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.empty((0, 0))


def _equations(model: Model):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, FEATURES, FEATURES + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(_stacked(batch, "x"))
                part, y = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("part", "y"))
                both = np.column_stack([z, y - model.base])
                for p in range(PARTS):
                    total[p] += z[part == p].T @ both[part == p]
        rows = pa.array(list(total.reshape(PARTS * FEATURES, -1)), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS * FEATURES)), rows], ["i", "sums"])

    return sums


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": [rows["i"].iloc[0]], "sums": [np.sum(np.stack(rows["sums"]), axis=0)]})


def _raw_scores(model: Model, ridges: np.ndarray):
    """Scores of rows by the weights that were fitted without their part."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, y = (batch.column(batch.schema.get_field_index(c)) for c in ("part", "y"))
            z = model.features(_stacked(batch, "x")) if batch.num_rows else np.empty((0, FEATURES))
            raw = model.base + (z * ridges[part.to_numpy()]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([y, pa.array(raw)], ["y", "raw"])

    return score


def pooled(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to y under weights n: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for mean, weight in zip(y, n):
        blocks.append([mean, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, c = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + m * w) / (last[1] + w)
            last[1] += w
            last[2] += c
    return np.concatenate([np.full(int(c), m) for m, _, c in blocks]) if blocks else np.empty(0)


def measure(docs: DataFrame, folds: int = 3) -> DataFrame:
    """doc_id, fold, part, x for every row of docs; part splits the rows that may be learned from."""
    small_batches(docs.sparkSession)
    slim = docs.select("doc_id", fold_of("doc_id", folds).alias("fold"), fold_of("doc_id", 30).alias("part"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return stash(slim.mapInArrow(_measured, f"doc_id {id_type}, fold long, part long, x array<double>"), "statistics")


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def fit(measured: DataFrame, labels: DataFrame, held_out: int = 1) -> Model:
    """Learns from rows outside the held-out fold only."""
    may = measured.filter(F.col("fold") != held_out)
    d = len(STATISTICS)
    moments = may.agg(*[F.avg(F.col("x")[i]) for i in range(d)], *[F.stddev_pop(F.col("x")[i]) for i in range(d)]).first()
    flat = np.array([0.0 if v is None else v for v in moments])
    model = Model(flat[:d], np.where(flat[d:] > 1e-9, flat[d:], 1.0))
    target = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    part = F.floor(F.col("part") / 3) % PARTS  # the fold is part % 3
    rows = stash(may.join(target, "doc_id").select(part.alias("part"), "x", "y"), "labelled")
    n, base = rows.agg(F.count("*"), F.avg("y")).first()
    if not n:
        model.values = np.array([0.5, 0.5])
        return model
    model.base = base
    # As many shares of the sums as there are cores, at most, whatever the files.
    shares = rows.coalesce(max(2, _cores(rows))).mapInArrow(_equations(model), "i long, sums array<double>")
    summed = shares.groupBy("i").applyInPandas(_added, "i long, sums array<double>").orderBy("i").collect()
    sums = np.array([r.sums for r in summed]).reshape(PARTS, FEATURES, FEATURES + 1)

    def solved(some: np.ndarray, share: float) -> np.ndarray:
        return np.linalg.solve(some[:, :-1] + RIDGE * n * share * np.eye(FEATURES), some[:, -1])

    model.ridge = solved(sums.sum(axis=0), 1)
    without = np.stack([solved(sums.sum(axis=0) - sums[p], 1 - 1 / PARTS) for p in range(PARTS)])
    binned = (
        rows.mapInArrow(_raw_scores(model, without), "y double, raw double")
        .groupBy(F.least(F.greatest(F.floor(F.col("raw") * BINS / 2 + BINS / 4), F.lit(0)), F.lit(BINS - 1)).alias("bin"))
        .agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("raw").alias("at")).orderBy("bin").collect()
    )
    model.knots = np.array([r["at"] for r in binned])
    model.values = pooled(np.array([r.y for r in binned]), np.array([float(r.n) for r in binned]))
    return model


def _scored(model: Model, held_out: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.clip(model.probability(_stacked(batch, "x")), 0, 1) if batch.num_rows else np.empty(0)
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fold == held_out), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return score


def report(docs: DataFrame, labels: DataFrame, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    measured = measure(docs)
    model = fit(measured, labels, held_out)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return measured.drop("part").mapInArrow(_scored(model, held_out), f"doc_id {id_type}, held_out boolean, score double, predicted int")


def _passing(model: Model):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(K.column_bytes(batch, "text"))
            yield batch.filter(pa.array(np.clip(model.probability(x), 0, 1) >= 0.5)) if len(x) else batch

    return keep


def keep_good(docs: DataFrame, labels: DataFrame, held_out: int = 1) -> DataFrame:
    """docs without those that the classifier rejects, columns unchanged; nothing is shuffled for it."""
    model = fit(measure(docs), labels, held_out)
    return docs.mapInArrow(_passing(model), docs.schema)
