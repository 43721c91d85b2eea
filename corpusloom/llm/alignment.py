"""Alignment of two tokenizers over whole texts, and how often their tokens meet in a corpus.

A task encodes its texts once with both tokenizers. Ends of tokens are running sums of byte lengths over
many texts at a time; ends that both have are cuts, and the cut at or after a token's end labels its group.
Two tokens are linked where their byte ranges overlap: each first token meets a run of second ones, which
repeats of indices write out at once. Ids of a pair are one number, first * size of the second vocabulary + second.

Texts of a partition form blocks of BLOCK_BYTES. What is shuffled is a block's distinct pairs with their counts, not the
links of its texts: they are summed by pair and salt, then by pair. The sums go back to the blocks that asked for
them, where each text adds up its own pairs, so no task holds more than one block, and no table of pairs is broadcast.
The highest count of each second id is: a row per id of that vocabulary at most.

Byte-level vocabularies whose ids are in merge order are encoded by rank; runs of white space that
encoder cannot take, and other vocabularies, go to the vocabulary's own library. Both give the same ids.

Cases: a text that is null or empty, or whose bytes either tokenizer does not give back, has no tokens: zeros
and an empty string; special tokens' strings are text; equal rows count each; any doc_id, null or repeated, is
carried along; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm.common import small_batches, stash

#: Bytes of text of a block, whose pairs are counted together, and salts of a pair in the first sum.
BLOCK_BYTES, SALTS = 1 << 24, 8
#: Runs of white space that the encoder by rank is not given.
_LONG_SPACE = re.compile(r"\s{1000}")
#: Fixed value: how byte-level vocabularies cut a text before merging.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level vocabulary from the text of its file; encode() takes the text as it is."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        self.own = Tokenizer.from_str(text)
        self.own.encode_special_tokens = True
        of, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]))
        for piece, i in vocabulary.items():
            if piece not in special:
                self.bytes[i] = bytes(map(of.__getitem__, piece))
        self.ranked = self._by_rank(spec, vocabulary)

    def _by_rank(self, spec: dict, vocabulary: dict[str, int]):
        """An encoder by rank where ids are in the order of merges and nothing else is done to a text; else None."""
        import tiktoken

        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"] or {}
        simple = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
        if not simple or spec["model"].get("ignore_merges") or [vocabulary.get(m) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        ranks = {b: i for i, b in enumerate(self.bytes) if b}
        return tiktoken.Encoding("own", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.ranked is None or _LONG_SPACE.search(text):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)


class Pieces:
    """A sentencepiece vocabulary from the bytes of its file; encode() puts the space in front itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = []
        for i in range(self.own.vocab_size()):
            piece = self.own.id_to_piece(i)
            given = b"" if self.own.is_control(i) or self.own.is_unknown(i) else piece.replace("▁", " ").encode()
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.own.is_byte(i) else given)

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text)


class Aligner:
    """Tokens, groups and links of batches of texts. first.encode() is given space + text, second.encode() the text."""

    def __init__(self, first: ByteLevel, second: Pieces):
        self.first, self.second = first, second
        self.lengths = [np.array(list(map(len, v.bytes)), np.int64) for v in (first, second)]
        self.sizes = [len(v.bytes) for v in (first, second)]
        # Decimal ids, each with what follows: a comma within a group's side, else the end of the side.
        self.names = [f"{i}{end}".encode() for size, ends in zip(self.sizes, (",|", ",;")) for end in ends for i in range(size)]

    def tokens(self, text: bytes | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        words, want = text.decode("utf-8", "replace"), b" " + text
        a = self.first.encode(" " + words)
        if b"".join(map(self.first.bytes.__getitem__, a)) != want:
            return [], []
        b = self.second.encode(words)
        return (a, b) if b"".join(map(self.second.bytes.__getitem__, b)) == want else ([], [])

    def align(self, texts: list[bytes | None]) -> dict:
        """Per text n_a, n_b, n_groups, n_links, digests and the bounds of its rows of codes (distinct, ascending) and times."""
        both = [self.tokens(t) for t in texts]
        n_a, n_b = (np.array([len(p[k]) for p in both], np.int64) for k in (0, 1))
        a, b = (np.fromiter((i for p in both for i in p[k]), np.int64, n.sum()) for k, n in ((0, n_a), (1, n_b)))
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)

        upto = np.append(0, np.cumsum(n_a))
        last = np.append(0, end_a)[upto]  # bytes up to the end of each text
        groups = np.searchsorted(cuts, last, side="right")
        first_b = np.searchsorted(end_b, end_a - self.lengths[0][a], side="right")
        run = np.searchsorted(end_b, end_a, side="left") - first_b + 1
        at = np.repeat(np.arange(len(a)), run)
        code = a[at] * self.sizes[1] + b[np.arange(len(at)) - np.repeat(np.cumsum(run) - run, run) + first_b[at]]
        own = np.repeat(np.arange(len(texts)), n_a)[at]
        span = self.sizes[0] * self.sizes[1]
        keys, times = np.unique(own * span + code, return_counts=True)

        # The tokens of both in the order of groups, the first tokenizer's before the second's.
        side = np.append(group_a * 2, group_b * 2 + 1)
        order = np.argsort(side, kind="stable")
        closes = np.append(side[order][1:] != side[order][:-1], len(side) > 0)
        base = np.append(a, b + 2 * self.sizes[0])[order]
        size = np.append(np.full(len(a), self.sizes[0]), np.full(len(b), self.sizes[1]))[order]
        name = (base + closes * size).tolist()
        where = np.append(0, np.cumsum(n_a + n_b)).tolist()
        named = [b"".join(map(self.names.__getitem__, name[x:y]))[:-1] for x, y in zip(where, where[1:])]
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups), "n_links": np.bincount(own, minlength=len(texts)),
            "groups_sha256": [hashlib.sha256(s).hexdigest() if s else "" for s in named],
            "bounds": np.searchsorted(keys, np.arange(len(texts) + 1) * span), "codes": keys % span, "times": times,
        }


_PARTS = "block long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>, whole boolean"
_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    times = np.zeros(len(codes), np.int64)
    np.add.at(times, back, np.concatenate([p[1] for p in parts]))
    return codes, times


def _aligned(first: str, second: bytes):
    """A row per text with its pairs, and one per block (whole) with the block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteLevel(first), Pieces(second))
        block, size, held = TaskContext.get().partitionId() << 32, 0, []
        id_type = pa.int64()

        def whole() -> pa.RecordBatch:
            codes, times = _summed(held)
            lists = [pa.array([codes], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))]
            none = [pa.nulls(1, id_type), *(pa.nulls(1, pa.int64()) for _ in _FIGURES), pa.nulls(1, pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *none, *lists, pa.array([True])], names)

        names = ["block", "doc_id", *_FIGURES, "groups_sha256", "codes", "times", "whole"]
        for batch in batches:
            texts, ids, id_type = K.column_bytes(batch, "text"), batch.column(0), batch.column(0).type
            for at, part in K.blocks(texts):
                got = aligner.align(part)
                n, lists = len(part), []
                for k in ("codes", "times"):
                    lists.append(pa.ListArray.from_arrays(pa.array(got["bounds"], pa.int32()), pa.array(got[k], pa.int64())))
                figures = [pa.array(got[k], pa.int64()) for k in _FIGURES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), ids.slice(at, n), *figures, pa.array(got["groups_sha256"], pa.string()), *lists, pa.array(np.zeros(n, bool))], names
                )
                held.append((got["codes"], got["times"]))
                size += sum(map(len, part))
                if size >= BLOCK_BYTES:
                    yield whole()
                    block, size, held = block + 1, 0, []
        if held:
            yield whole()

    return run


def _looked_up(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The texts of one block with the corpus-wide figures of their pairs."""
    texts, pairs = texts.combine_chunks(), pairs.sort_by("code").combine_chunks()
    code, total, best = (pairs.column(k).to_numpy() for k in ("code", "total", "best"))
    lists = texts.column("codes").combine_chunks()
    at = np.searchsorted(code, lists.flatten().to_numpy())
    times = texts.column("times").combine_chunks().flatten().to_numpy()
    bounds = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
    sums = [np.diff(np.append(0, np.cumsum(times * x[at]))[bounds]) for x in (best.astype(np.int64), total)]
    held = texts.select(["doc_id", *_FIGURES])
    for name, x in zip(("n_best", "count_sum"), sums):
        held = held.append_column(name, pa.array(x, pa.int64()))
    return held.append_column("groups_sha256", texts.column("groups_sha256"))


def pair_counts(parts: DataFrame, second_size: int) -> DataFrame:
    """code, total, best: corpus-wide links of each pair, and whether no pair of its second id has more."""
    asked = parts.filter("whole").select("block", F.explode(F.arrays_zip("codes", "times")).alias("p"))
    salted = asked.groupBy(F.col("p.codes").alias("code"), F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("p.times").alias("n"))
    counts = stash(salted.groupBy("code").agg(F.sum("n").alias("total")), "pairs")
    second = F.col("code") % second_size
    highest = counts.groupBy(second.alias("second")).agg(F.max("total").alias("most"))  # a row per id of the vocabulary at most
    return counts.join(F.broadcast(highest), second == F.col("second")).select("code", "total", (F.col("total") == F.col("most")).alias("best"))


def _parts(docs: DataFrame, first: str, second: str) -> tuple[DataFrame, int]:
    """The aligned texts and blocks, and the size of the second vocabulary; the files' contents go to the tasks."""
    small_batches(docs.sparkSession)
    with open(first, encoding="utf-8") as f:
        a = f.read()
    with open(second, "rb") as f:
        b = f.read()
    out = _PARTS.format(id=docs.schema["doc_id"].dataType.simpleString())
    return stash(docs.select("doc_id", "text").mapInArrow(_aligned(a, b), out), "aligned"), len(Pieces(b).bytes)


def report(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per document.

    first: path of a byte-level vocabulary (JSON), second: path of a sentencepiece model.
    """
    parts, size = _parts(docs, first, second)
    told = parts.filter("whole").select(F.col("block").alias("asker"), F.explode("codes").alias("code")).join(pair_counts(parts, size), "code")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    texts = parts.filter("not whole").drop("whole")
    return texts.groupBy("block").cogroup(told.groupBy("asker")).applyInArrow(_looked_up, out)


def pairs(docs: DataFrame, first: str, second: str) -> DataFrame:
    """first_id, second_id, links, best: how often each pair of token ids is linked in the corpus; best: no pair of second_id has more."""
    parts, size = _parts(docs, first, second)
    code = F.col("code")
    return pair_counts(parts, size).select(F.floor(code / size).cast("long").alias("first_id"), (code % size).alias("second_id"), F.col("total").alias("links"), "best")
