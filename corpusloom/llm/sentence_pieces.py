"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A text becomes pieces of a public model. Ordinary documents are encoded whole, each by one call of the
sentencepiece library. A document of more than `giant` characters is cut into chunks of equal
length that different tasks work on:

1. A chunk's boundary states are the pieces that may lie across or end at a boundary. Its transfer
   matrix holds the best score of a path from each state at its left to each at its right, -inf
   where there is none. Scores add along a path and the best path wins: products are max-plus.
2. The matrices of a document are combined associatively, and the best state at each boundary is read
   off backwards.
3. Each chunk, given its two boundary states, is backtraced by itself; the parts are put together.

Between two places where no piece can cross (a space after a word, a character of no piece) all paths
meet, so only the ends of a chunk need the lattice; the middle is one call of the library.

For a unigram model a piece scores its log probability. A merge model (BPE) has no scores to add: a
sequence of pieces is its encoding exactly if each two neighbours, encoded alone, stay as they are. Its
paths thus score 0 over pairs that stay and -inf over others, and exactly one path is left, which
is the library's encoding.

Cases: null and empty text have no tokens; characters of no piece become byte pieces where the model has
them, else the unknown piece; U+2581 in a text is not told apart from a space, so such a text does not
round-trip (round_trip false, as for unknown characters without byte pieces); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, stash

SPACE = "▁"
#: Characters of a chunk; documents of more than GIANT characters are cut.
CHUNK, GIANT = 16_384, 32_768


class PieceModel:
    """What the lattice needs of a model file: pieces, scores, kind; the library does whole texts."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.proto = proto
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.joins = {c for p in self.ids if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that hold a space after a word are not supported")
        self.unigram = is_unigram(proto)
        self.worst = min(self.scores.values()) - 10.0  # of a character of no piece
        self.pairs: dict[tuple[str, str], bool] = {}

    def score(self, piece: str) -> float:
        return self.scores.get(piece, self.worst) if self.unigram else 0.0

    def merged(self, text: str) -> list[str]:
        """The merge model's encoding of a short text: best-scored neighbours first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, a: str, b: str) -> bool:
        """May b follow a?"""
        if self.unigram:
            return True
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def crossable(self, left: str, right: str) -> bool:
        """Can any piece reach over these two neighbouring characters?"""
        return left in self.joins and right in self.joins and not (right == SPACE and left != SPACE)

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces that may start at this place; a character of no piece stands for itself."""
        found = [text[at]]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            if text[at : at + n] in self.ids and (self.unigram or self.merged(text[at : at + n]) == [text[at : at + n]]):
                found.append(text[at : at + n])
        return found

    def encode(self, spaced: str) -> list[int]:
        """Ids of a stretch that starts where no piece can cross."""
        if spaced.startswith(SPACE):
            return self.sp.encode(spaced[1:]) if len(spaced) > 1 else self.piece_ids(SPACE)
        if self.unigram:  # without its leading space the library would add one
            return [i for p in best_path(self, spaced, 0, len(spaced), None, None) for i in self.piece_ids(p)]
        return [i for p in self.merged_long(spaced) for i in self.piece_ids(p)]

    def merged_long(self, text: str) -> list[str]:
        """merged() over the stretches of characters that pieces can join."""
        out, start = [], 0
        for i in range(1, len(text) + 1):
            if i == len(text) or not self.crossable(text[i - 1], text[i]):
                out += self.merged(text[start:i]) if i - start <= 512 else best_path(self, text[start:i], 0, i - start, None, None)
                start = i
        return out

    def piece_ids(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode()]
        return [self.sp.unk_id()]


def is_unigram(proto: bytes) -> bool:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(proto)
    return model.trainer_spec.model_type == 1


def spaced(text: str) -> str:
    """What pieces are matched against: spaces made visible, one added in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def states(model: PieceModel, text: str, at: int) -> list[tuple[int, int]]:
    """The pieces, by start and end, that start before a boundary and end at or after it."""
    found = []
    for start in range(max(0, at - model.longest), at):
        found += [(start, start + len(p)) for p in model.starting(text, start) if start + len(p) >= at]
    return found


def lattice(model: PieceModel, text: str, begin: int, end: int, sources: list[tuple[int, int] | None], paths: bool = False):
    """Best scores from each source to each piece that starts in [begin, end), as {(start, end): scores}.

    A source is a piece that ends at or after begin, or None: nothing before begin. With paths, each
    piece also gets the piece before it on the best path of the first source.
    """
    ending: dict[int, list[tuple[int, int]]] = {}
    score: dict[tuple[int, int], np.ndarray] = {}
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for k, s in enumerate(sources):
        node = s or (begin, begin)
        score.setdefault(node, np.full(len(sources), -np.inf))[k] = 0.0
        if node not in ending.setdefault(node[1], []):
            ending[node[1]].append(node)
    for at in range(begin, end):
        before = ending.get(at)
        if not before:
            continue
        for piece in model.starting(text, at):
            node, gain = (at, at + len(piece)), model.score(piece)
            for b in before:
                if b[0] == b[1] or model.stays(text[b[0] : b[1]], piece):
                    reached = score[b] + gain
                    if node not in score:
                        score[node] = reached
                        back[node] = b
                        ending.setdefault(node[1], []).append(node)
                    else:
                        if reached[0] > score[node][0]:
                            back[node] = b
                        score[node] = np.maximum(score[node], reached)
    return (score, back) if paths else score


def best_path(model: PieceModel, text: str, begin: int, end: int, source: tuple[int, int] | None, target: tuple[int, int] | None) -> list[str]:
    """Pieces after source up to and with target (None: up to exactly end)."""
    score, back = lattice(model, text, begin, end, [source], paths=True)
    first = source or (begin, begin)
    if target is None:
        ends = [n for n in score if n[1] == end]
        target = max(ends, key=lambda n: (score[n][0], n[0])) if ends else first
    out = []
    while target != first:
        out.append(text[target[0] : target[1]])
        target = back[target]
    return out[::-1]


def _meeting(model: PieceModel, text: str, places: range) -> int:
    """The first of places where no piece can cross and a word begins, or -1."""
    for i in places:
        if text[i] == SPACE and text[i - 1] != SPACE:
            return i
    return -1


def transfer(model: PieceModel, text: str, begin: int, end: int, last: bool) -> tuple[list, list, np.ndarray]:
    """States at begin and at end (as offsets to each), and the matrix of best scores between them.

    text holds the chunk [begin, end) and enough on either side; begin 0 is the document's start.
    """
    left = states(model, text, begin) if begin else [None]
    right = [s for s in states(model, text, end) if not last or s[1] == end]
    matrix = np.full((len(left), len(right)), -np.inf)
    first = _meeting(model, text, range(begin + 1 + model.longest, end - model.longest))
    if first < 0:
        reached = lattice(model, text, begin, end, left)
        for j, s in enumerate(right):
            if s in reached:
                matrix[:, j] = reached[s]
    else:
        final = _meeting(model, text, range(end - model.longest - 1, first - 1, -1))
        head = lattice(model, text, begin, first, left)
        into = np.maximum.reduce([v for n, v in head.items() if n[1] == first] or [matrix[:, 0]])
        middle = sum(model.sp.get_score(i) for i in model.encode(text[first:final])) if model.unigram else 0.0
        tail = lattice(model, text, final, end, [None])
        for j, s in enumerate(right):
            if s in tail:
                matrix[:, j] = into + middle + tail[s][0]
    rel = lambda some, at: [(-1, -1) if s is None else (at - s[0], s[1] - at) for s in some]
    return rel(left, begin), rel(right, end), matrix


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, which is associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def chunk_pieces(model: PieceModel, text: str, begin: int, end: int, entry: tuple[int, int], leave: tuple[int, int]) -> list[int]:
    """Ids of the pieces that start in the chunk, on the path between its two boundary states."""
    source = None if entry == (-1, -1) else (begin - entry[0], begin + entry[1])
    target = (end - leave[0], end + leave[1])
    first = _meeting(model, text, range(begin + 1 + model.longest, end - model.longest))
    if first < 0:
        return [i for p in best_path(model, text, begin, end, source, target) for i in model.piece_ids(p)]
    final = _meeting(model, text, range(end - model.longest - 1, first - 1, -1))
    head = best_path(model, text, begin, first, source, None)
    tail = best_path(model, text, final, end, None, target)
    ends = [[i for p in part for i in model.piece_ids(p)] for part in (head, tail)]
    return [*ends[0], *(model.encode(text[first:final]) if final > first else []), *ends[1]]


def boundary_path(matrices: list[np.ndarray]) -> list[int]:
    """The state at each boundary on the best path through all matrices, the first state being alone."""
    upto = [np.zeros((1, 1))]
    for m in matrices:
        upto.append(combined(upto[-1], m))
    at = [int(upto[-1][0].argmax())]
    for m, before in zip(matrices[::-1], upto[-2::-1]):
        at.append(int((before[0] + m[:, at[-1]]).argmax()))
    return at[::-1]


_models: dict[int, PieceModel] = {}


def _model(proto: bytes) -> PieceModel:
    """One per worker."""
    key = hash(proto)
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(proto)
    return _models[key]


def _lists(parts: list) -> pa.Array:
    flat = np.concatenate([np.asarray(p, np.int32) for p in parts]) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)), pa.array(flat))


def _whole(proto: bytes):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _model(proto).sp
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = sp.encode(texts, num_threads=1)
            ok = [sp.decode(i) == t if t else True for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids), pa.array(ok, pa.bool_())], ["doc_id", "token_ids", "round_trip"])

    return encode


def _transfers(proto: bytes):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto)
        for batch in batches:
            rows = []
            for row, k, text, begin, end, last in zip(*(c.to_pylist() for c in batch.columns)):
                left, right, m = transfer(model, text, begin, end, last)
                rows.append((row, k, [x for s in left for x in s], [x for s in right for x in s], m.ravel()))
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["row", "k", "entries", "exits", "matrix"])

    return scan


def _chosen(rows: pd.DataFrame) -> pd.DataFrame:
    """The boundary states of one document's chunks: a few numbers for each chunk."""
    rows = rows.sort_values("k")
    entries = [np.reshape(e, (-1, 2)) for e in rows["entries"]]
    exits = [np.reshape(e, (-1, 2)) for e in rows["exits"]]
    at = boundary_path([np.reshape(m, (len(a), len(b))) for m, a, b in zip(rows["matrix"], entries, exits)])
    come = np.array([e[i] for e, i in zip(entries, at)])
    go = np.array([e[i] for e, i in zip(exits, at[1:])])
    return pd.DataFrame({"row": rows["row"].to_numpy(), "k": rows["k"].to_numpy(), "a": come[:, 0], "b": come[:, 1], "c": go[:, 0], "d": go[:, 1]})


def _backtraced(proto: bytes):
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(proto)
        for batch in batches:
            ids = [
                chunk_pieces(model, text, begin, end, (a, b), (c, d))
                for text, begin, end, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns[2:]))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(ids)], ["row", "k", "ids"])

    return trace


def _checked(proto: bytes):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _model(proto).sp
        for batch in batches:
            ok = [sp.decode(i) == t for t, i in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ok, pa.bool_())], ["doc_id", "token_ids", "round_trip"])

    return check


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK, giant: int = GIANT) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip: one row per document, the ids those of the library."""
    small_batches(docs.sparkSession, 128)
    with open(model_path, "rb") as f:  # on the driver; workers get the bytes
        proto = f.read()
    model = PieceModel(proto)
    if chunk < 4 * model.longest:
        raise ValueError("chunks must be longer than four of the longest pieces")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, token_ids array<int>, round_trip boolean"
    slim = docs.select("doc_id", "text")
    small = slim.filter(F.coalesce(F.length("text"), F.lit(0)) <= giant).mapInArrow(_whole(proto), out)
    large = stash(slim.filter(F.length("text") > giant).withColumn("row", F.monotonically_increasing_id()), "giants")
    if large.isEmpty():
        return small.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")
    # Chunk k holds the visible text's characters [k * chunk, (k + 1) * chunk), the last one what is left.
    side = 2 * model.longest
    text = F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE)))
    cut = (
        large.select("row", text.alias("t"), (F.length("text") + 1).alias("n"))
        .withColumn("chunks", F.greatest(F.floor(F.col("n") / chunk), F.lit(1)))
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .withColumn("from", F.col("k") * chunk)
        .withColumn("to", F.when(F.col("k") == F.col("chunks") - 1, F.col("n")).otherwise(F.col("from") + chunk))
        .withColumn("lead", F.least("from", F.lit(side)))
        .select(
            "row",
            "k",
            F.expr(f"substring(t, int(from - lead + 1), int(to - from + lead + {side}))").alias("part"),
            F.col("lead").alias("begin"),
            (F.col("lead") + F.col("to") - F.col("from")).alias("end"),
            (F.col("to") == F.col("n")).alias("last"),
        )
    )
    cut = stash(cut.repartition("row", "k"), "chunks")
    matrices = cut.mapInArrow(_transfers(proto), "row long, k long, entries array<long>, exits array<long>, matrix array<double>")
    chosen = stash(matrices.groupBy("row").applyInPandas(_chosen, "row long, k long, a long, b long, c long, d long"), "boundaries")
    traced = cut.join(chosen, ["row", "k"]).select("row", "k", "part", "begin", "end", "a", "b", "c", "d").mapInArrow(_backtraced(proto), "row long, k long, ids array<int>")
    whole = traced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    joined = large.join(whole, "row").select("doc_id", "text", F.flatten("parts.ids").alias("token_ids"))
    both = small.unionByName(joined.mapInArrow(_checked(proto), out))
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


def _decoder(proto: bytes):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _model(proto).sp
        for batch in batches:
            texts = [None if i is None else sp.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return decode


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from doc_id, token_ids; null stays null."""
    with open(model_path, "rb") as f:
        proto = f.read()
    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "token_ids").mapInArrow(_decoder(proto), f"doc_id {id_type}, text string")
