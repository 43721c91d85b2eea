"""Token ids of a byte-level vocabulary: byte pairs merged in the order of their ranks, as an Arrow column function.

A text is cut into words by the vocabulary's pattern. A word's bytes are a linked list; a heap holds its neighbouring pairs
by rank and place, so a word of n bytes takes n log n steps. Ids of words already met are remembered up to a bound.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers, and the most characters of such a word.
REMEMBERED, SHORT = 200_000, 64


def byte_of() -> dict[str, int]:
    """The characters that stand for bytes in the files: printable ones for themselves, the others from 256 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A vocabulary from the text of its file: bytes of each id, and rank and result of each pair of ids that merges."""

    def __init__(self, text: str):
        model, of = json.loads(text)["model"], byte_of()
        vocabulary = {piece: i for piece, i in model["vocab"].items() if all(c in of for c in piece)}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(map(of.__getitem__, piece))
        self.single = [0] * 256
        for c, b in of.items():
            self.single[b] = vocabulary[c]
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merged.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        self.words = regex.compile(WORDS)
        self.known: dict[str, array] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(at: int) -> None:
            if 0 <= at and after[at] < n and (found := self.merged.get((ids[at], ids[after[at]]))):
                heapq.heappush(heap, (found[0], at, ids[at], ids[after[at]], found[1]))

        for at in range(n - 1):
            offer(at)
        while heap:
            _, at, left, right, new = heapq.heappop(heap)
            follower = after[at]
            if ids[at] != left or follower >= n or ids[follower] != right:
                continue  # one of the two has been merged since
            ids[at], ids[follower] = new, -1
            after[at] = after[follower]
            if after[at] < n:
                before[after[at]] = at
            offer(at)
            offer(before[at])
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.words.findall(text):
            got = self.known.get(word)
            if got is None:
                got = self.merge(word.encode())
                if len(word) <= SHORT:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[word] = array("i", got)
            out += got
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.bytes[i] for i in ids)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def ids(self, text: Column) -> Column:
        """array<int>: the ids of a text; null stays null."""

        @F.pandas_udf("array<int>")
        def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in texts:
                yield batch.map(lambda t: None if t is None else self.encode(t))

        return encoded(text)

    def text_of(self, ids: Column) -> Column:
        """string: the text of ids, those beyond the vocabulary left out; bytes that are no text become replacement characters."""

        pieces = self.bytes  # a worker that decodes gets no pairs

        @F.pandas_udf("string")
        def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(lambda x: None if x is None else b"".join([pieces[i] for i in x if 0 <= i < len(pieces)]).decode("utf-8", "replace"))

        return decoded(ids)


def read(path: str) -> ByteLevel:
    """A vocabulary from a JSON file of vocab and merges."""
    with open(path, encoding="utf-8") as f:
        return ByteLevel(f.read())
