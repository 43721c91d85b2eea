"""Token ids of a byte-level vocabulary against merging by hand and against a public library."""

import json
import random

import pytest

from corpusloom.functions import bpe
from corpusloom.operators import corpus
from corpusloom.plans.corpus_queries import BYTE_LEVEL

TEXTS = [
    "", " ", "hello world", "I'm we'll they'd 'tis", "tabs\tand\r\nlines\n\n  x ", "naïve café Привет 日本語 👩‍👩‍👧 ́", "<|endoftext|> is text here", "aaaaaaaaaaaaaaaaaaaaaaab",
    "a" * 700, "x" + " " * 900 + "y", "1234567890" * 9, "\x00\x7f\x80", "　wide", "==== ---- ^^^^",
]


@pytest.fixture(scope="module")
def known():
    return bpe.read(BYTE_LEVEL)


def by_hand(known, word):
    """The pair of the least rank merges first, the leftmost on ties, until none is left."""
    ids = [known.single[b] for b in word]
    while True:
        pairs = [(known.merged[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in known.merged]
        if not pairs:
            return ids
        _, k = min(pairs)
        ids[k : k + 2] = [known.merged[ids[k], ids[k + 1]][1]]


def test_ids_equal_merging_by_hand(known):
    rng = random.Random(1)
    words = [w.encode() for t in TEXTS for w in known.words.findall(t)] + [bytes(rng.choice(b"etaoin srh") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    for w in words:
        assert known.merge(w) == by_hand(known, w)


def test_ids_equal_those_of_the_library(known):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTE_LEVEL)
    own.encode_special_tokens = True
    for t in TEXTS:
        ids = known.encode(t)
        assert ids == own.encode(t, add_special_tokens=False).ids
        assert known.decode(ids) == t.encode()


def test_small_vocabulary_in_both_spellings_of_merges():
    vocabulary = {c: k for k, c in enumerate(bpe.byte_of())} | {"ab": 256, "abc": 257, "bc": 258}
    for merges in (["b c", "a b", "ab c"], [["b", "c"], ["a", "b"], ["ab", "c"]]):
        small = bpe.ByteLevel(json.dumps({"model": {"vocab": vocabulary, "merges": merges}}))
        assert [small.decode([i]) for i in small.encode("abcab")] == [b"a", b"bc", b"ab"]


def test_columns_of_ids(spark, known):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "k int, t string").repartition(3)
    got = df.select("k", known.ids(F.col("t")).alias("ids")).select("k", "ids", known.text_of(F.col("ids")).alias("t")).collect()
    assert {r.k: r.t for r in got} == dict(enumerate([*TEXTS, None]))
    assert all(r.ids == known.encode(TEXTS[r.k]) for r in got if r.t is not None)


def test_chat_rows_in_ids(spark, known):
    rows = [(1, 0, "user", "hi there"), (1, 1, "assistant", "hello"), (1, 2, "user", None), (2, 0, "assistant", "first is dropped"), (2, 1, "user", "x"), (3, 0, "system", "quiet")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    start, end, pad = (len(known.bytes) + k for k in range(3))
    e = known.encode
    head = [start, *e("system"), *e("\n"), *e("Be brief."), end, *e("\n")]
    head_l = [start, *[-100] * (len(head) - 3), end, *e("\n")]

    def turn(role, text):
        return [start, *e(role), *e("\n"), *e(text), end, *e("\n")]

    def label(role, text):
        skipped = len(e(role)) + 1 + (len(e(text)) if role == "user" else 0)
        return [start, *[-100] * skipped, *(e(text) if role != "user" else []), end, *e("\n")]

    said = {1: [("user", "hi there"), ("assistant", "hello"), ("user", "")], 2: [("user", "x")], 3: []}
    for most in (None, 40, 9):
        got = corpus.chat_token_ids(turns, "conv_id", "turn", "role", "text", most, known, system="Be brief.").collect()
        assert len(got) == 3
        for r in got:
            ids = head + [i for t in said[r.conv_id] for i in turn(*t)]
            labels = head_l + [i for t in said[r.conv_id] for i in label(*t)]
            n = len(ids) if most is None else most
            assert r.input_ids == (ids + [pad] * n)[:n] and r.labels == (labels + [-100] * n)[:n]
            assert r.attention_mask == [True] * min(n, len(ids)) + [False] * max(0, n - len(ids))
