"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Whole texts become counts of hashed character 1- to 3-grams (lower case, runs of anything but
letters read as spaces). Document frequencies come from all rows that may be learned from. The weights
are learned by follow-the-regularised-leader with elastic-net penalties on a bounded sample: at most
`sample` texts in all, an equal share for each language (one text at least), the distinct ones with the
least hashes, so that neither copies nor partitions have a say in it. A fifth of the sample sets the softmax
temperature. The model holds a weight for every bucket and language; languages are its classes, which
the driver must hold as it holds the model.

Cases: null text or text without a letter is `und` with score 0; rows without a language are
predicted but not learned from; a null doc_id counts as empty text for the fold; without any
language to learn every text is `und`; an empty table gives an empty result; of the columns other
than text, lang serves as the learning target alone and doc_id for the fold alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import fold_of, small_batches

BUCKETS, SAMPLE = 1 << 14, 2400
#: follow-the-regularised-leader: learning rate, smoothing, absolute and square penalties, epochs, batch.
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 0.5, 1.0, 0.002, 0.001, 6, 32
BLOCK_CHARS = 1 << 19

_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter, of Unicode's categories L only: no digits, fractions or enclosed numbers."""
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: first index, number, and the text, bucket and count of each n-gram bucket in use."""
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= BLOCK_CHARS):
            chars += len(texts[j]) + 1
            j += 1
        lowered = [t.lower() for t in texts[i:j]]
        code = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(code < 128, _PLAIN[np.minimum(code, 127)], code)
        own = np.repeat(np.arange(j - i), [len(t) + 1 for t in lowered])
        used = []
        h = np.zeros(len(code), np.uint32)
        for order in range(1, 4):
            # A gram may reach over the separator into the next text's first letters; cut those off.
            h = h[: len(code) - order + 1] * np.uint32(0x01000193) + code[order - 1 :]
            same = own[: len(h)] == own[order - 1 :]
            bucket = ((h ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(18)
            used.append((own[: len(h)] * BUCKETS + bucket)[same])
        counts = np.bincount(np.concatenate(used), minlength=(j - i) * BUCKETS)
        at = np.flatnonzero(counts)
        yield i, j - i, at // BUCKETS, at % BUCKETS, counts[at]
        i = j


def _strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket and partition: the texts that use it."""
    seen = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, _, bucket, _ in gram_counts(_strings(batch, "text")):
            seen += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "texts"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column(batch.schema.get_field_index("lang"))
        for i, n, own, bucket, count in gram_counts(_strings(batch, "text")):
            cuts = np.searchsorted(own, np.arange(n + 1))
            parts = list(zip(cuts, cuts[1:]))
            lists = [pa.array([x[a:b] for a, b in parts], pa.list_(pa.int32())) for x in (bucket.astype(np.int32), count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([lang.slice(i, n), *lists], ["lang", "buckets", "counts"])


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf
        self.weights = np.zeros((BUCKETS, len(langs)))
        self.bias = np.zeros(len(langs))
        self.temperature = 1.0

    def values(self, n: int, own: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        """TF-IDF of unit length per text."""
        v = np.log1p(count) * self.idf[bucket]
        norm = np.sqrt(np.bincount(own, v * v, n))
        return v / np.where(norm > 0, norm, 1)[own]

    def logits(self, n: int, own: np.ndarray, bucket: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(own, v * self.weights[bucket, c], n) + self.bias[c] for c in range(len(self.langs))], axis=1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _train(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 5) -> None:
    """rows: language number, buckets, counts. Sets weights, bias and temperature."""
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    apart = rows[: len(rows) // 5]
    learn = rows[len(rows) // 5 :] or rows

    def batch_of(some):
        own = np.repeat(np.arange(len(some)), [len(r[1]) for r in some])
        bucket = np.concatenate([r[1] for r in some]).astype(np.int64)
        v = model.values(len(some), own, bucket, np.concatenate([r[2] for r in some]))
        return own, bucket, v, np.array([r[0] for r in some])

    classes = len(model.langs)
    z, squares = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    weights = np.zeros_like(z)
    for _ in range(EPOCHS):
        for at in range(0, len(learn), BATCH):
            own, bucket, v, y = batch_of(learn[at : at + BATCH])
            n = len(y)
            model.weights, model.bias = weights[:-1], weights[-1]
            error = softmax(model.logits(n, own, bucket, v))
            error[np.arange(n), y] -= 1
            g = np.zeros_like(z)
            for c in range(classes):
                g[:-1, c] = np.bincount(bucket, v * error[own, c], BUCKETS)
            g[-1] = error.sum(axis=0)
            root = np.sqrt(squares + g * g)
            z += g - (root - np.sqrt(squares)) / ALPHA * weights
            squares += g * g
            weights = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + root) / ALPHA + L2), 0.0)
    model.weights, model.bias = weights[:-1], weights[-1]
    if apart:
        own, bucket, v, y = batch_of(apart)
        raw = model.logits(len(y), own, bucket, v)
        tried = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        loss = [-np.log(np.maximum(softmax(raw / t)[np.arange(len(y)), y], 1e-12)).mean() for t in tried]
        model.temperature = float(tried[int(np.argmin(loss))])


def fit(docs: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Model | None:
    small_batches(docs.sparkSession)
    may = docs.select("text", "lang", fold_of("doc_id", folds).alias("fold")).filter((F.col("fold") != held_out) & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in may.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    seen = may.select("text").mapInArrow(_frequencies, "bucket long, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts")).collect()
    total = sum(counts.values())
    idf = np.full(BUCKETS, np.log(1 + total) + 1)
    for r in seen:  # BUCKETS rows at most
        idf[r.bucket] = np.log((1 + total) / (1 + r.texts)) + 1
    model = Model(sorted(counts), idf)
    share = max(1, sample // len(counts))
    # Equal texts count once. The share's least hashes come from a bounded number of rows: of each language and salt, then of each language.
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    distinct = may.select("lang", key.alias("digest")).distinct().withColumn("salt", F.substring("digest", 31, 2))
    drawn = distinct
    for parts in (["lang", "salt"], ["lang"]):
        least = Window.partitionBy(*parts).orderBy("digest")
        drawn = drawn.withColumn("k", F.row_number().over(least)).filter(F.col("k") <= share)
    drawn = drawn.select("lang", "digest")  # share rows a language at most
    chosen = may.select("text", "lang", key.alias("digest")).join(F.broadcast(drawn), ["lang", "digest"]).dropDuplicates(["lang", "digest"])
    rows = chosen.select("text", "lang").mapInArrow(_counted, "lang string, buckets array<int>, counts array<int>")
    number = {k: i for i, k in enumerate(model.langs)}
    table = rows.toArrow()
    picked = [(number[k], b.values.to_numpy(), c.values.to_numpy()) for k, b, c in zip(table["lang"].to_pylist(), table["buckets"], table["counts"]) if len(b)]
    picked.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))  # reruns see one order, whatever the partitions
    if picked:
        _train(model, picked)
    return model


def _predicted(model: Model | None, held_out: int):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _strings(batch, "text")
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            if model is not None:
                for i, n, own, bucket, count in gram_counts(texts):
                    p = softmax(model.logits(n, own, bucket, model.values(n, own, bucket, count)) / model.temperature)
                    best[i : i + n], score[i : i + n] = p.argmax(axis=1), p.max(axis=1)
            letters = np.array([model is not None and has_letter(t) for t in texts], bool)
            langs = [model.langs[b] if ok else "und" for b, ok in zip(best, letters)]
            fold = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fold == held_out), pa.array(langs, pa.string()), pa.array(np.where(letters, score, 0.0))],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return predict


def report(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""
    model = fit(docs, folds, held_out)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", fold_of("doc_id", folds).alias("fold"), "text")
    return slim.mapInArrow(_predicted(model, held_out), f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
