"""Greedy word-piece token counts from a linear longest-match automaton.

Two tries, for pieces that begin words and for pieces that continue them, get failure links: where no
piece goes on, the automaton knows how many pieces the text read so far pops and which node of the
continuing trie stands for what is left. Only the number of popped pieces is kept, so counting a
word takes one step per character and builds no piece. Where the vocabulary has the bare word start,
it is the first piece of words that no longer one begins, and with byte pieces a character that no
piece begins with counts as its UTF-8 bytes. A word that still cannot be covered counts as one
unknown token, as usual for greedy word pieces. Words are runs without `[\\x20\\x09-\\x0D]`.

Counts of words already met are kept in a bounded table per worker; it saves time, no result rests on it.

Cases: null or blank text has 0 tokens; words of any length are counted whole; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import kernels as K
from corpusloom.llm.common import small_batches

#: Words of which a worker remembers the counts; the table starts afresh beyond.
REMEMBERED = 400_000
_UNKNOWN = 1 << 40


class LongestMatch:
    """Counts of greedy longest pieces of a word.

    bare: the word start is a piece by itself; byte_pieces: characters of no piece count as their bytes.
    """

    def __init__(self, initial: Iterable[str], continuing: Iterable[str], bare: bool = False, byte_pieces: bool = False):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0 begins words, node 1 continues them
        self.byte_pieces = byte_pieces
        initial, continuing = list(initial), list(continuing)
        # The characters of longer pieces; count() sees to all others.
        single = sorted(set("".join(initial + continuing)) - set(continuing)) if byte_pieces else []
        ends = {}
        for root, pieces in ((0, initial), (1, continuing), (1, single)):
            for piece in pieces:
                node = root
                for ch in piece:
                    node = self.next[node].setdefault(ch, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                if piece:
                    ends[node] = len(piece.encode()) if pieces is single else 1
        #: Where to go on when a node has no such child (-1: nowhere), and the pieces popped on the way.
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        if bare:
            self.fail[0], self.popped[0] = 1, 1
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for ch, child in self.next[node].items():
                    below.append(child)
                    if child in ends:
                        self.fail[child], self.popped[child] = 1, ends[child]
                        continue
                    at, popped = self.fail[node], self.popped[node]
                    while at >= 0 and ch not in self.next[at]:
                        popped += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.next[at][ch], popped
            level = below

    def count(self, word: str) -> int:
        """The number of pieces, or -1 if the word cannot be covered."""
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for ch in word:
            while ch not in step[node]:
                if fail[node] < 0:
                    if node == 1 and self.byte_pieces:
                        total += len(ch.encode())
                        break
                    return -1
                total += popped[node]
                node = fail[node]
            else:
                node = step[node][ch]
        while node > 1:
            if fail[node] < 0:
                return -1
            total += popped[node]
            node = fail[node]
        return total


class _Remembered(dict):
    """word -> tokens, plus _UNKNOWN where the word is unknown."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode())
        n = n if n >= 0 else 1 + _UNKNOWN
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def read_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Word pieces from a public sentencepiece file: its word-initial pieces, and those that continue."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    return [p[1:] for p in pieces if p[0] == "▁" and p.strip("▁")], [p for p in pieces if "▁" not in p]


def read_fallbacks(path: str) -> tuple[bool, bool]:
    """Whether a public sentencepiece file has the bare word start, and whether it has all byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.vocab_size()
    return "▁" in map(sp.id_to_piece, range(size)), sum(map(sp.is_byte, range(size))) == 256


def _counter(vocabulary: tuple[list[str], list[str]], bare: bool, byte_pieces: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Remembered(LongestMatch(*vocabulary, bare, byte_pieces))
        for batch in batches:
            tokens, words, unknown = [], [], []
            for t in K.column_bytes(batch, "text"):
                parts = (t or b"").split()
                both = sum(map(known.__getitem__, parts))
                tokens.append(both % _UNKNOWN)
                unknown.append(both // _UNKNOWN)
                words.append(len(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    return count


def report(docs: DataFrame, vocabulary: tuple[list[str], list[str]], bare: bool = False, byte_pieces: bool = False) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown: one row per document, no shuffle."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n_words long, n_tokens long, n_unknown long"
    return docs.select("doc_id", "text").mapInArrow(_counter(vocabulary, bare, byte_pieces), out)
