"""Alignment of two tokenizers against a plain version that looks at every pair of tokens."""

import hashlib
import os
import random
from collections import Counter

import pytest

from corpusloom.llm import alignment, queries
from tests.llm.fixtures import awkward, documents, prose

os.environ["TOKENIZERS_PARALLELISM"] = "false"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain_tokens():
    """text -> [(id, bytes)] of both vocabularies, by their own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    letters = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for n, c in enumerate(c for c in range(256) if chr(c) not in letters):
        letters[chr(256 + n)] = c

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def both(text):
        if not text:
            return [], []
        one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, piece(i)) for i in b.encode(text)]
        same = b"".join(t for _, t in one) == b"".join(t for _, t in two) == (" " + text).encode()
        return (one, two) if same else ([], [])

    return both


def plain(rows, tokens):
    linked, out = [], []
    for doc_id, text in rows:
        spans, ids = [], []
        for side in tokens(text):
            at, held = 0, []
            for i, b in side:
                held.append((at, at + len(b), i))
                at += len(b)
            spans.append(held)
            ids.append([i for i, _ in side])
        a, b = spans
        links, j = [], 0
        for x in a:
            while j < len(b) and b[j][1] <= x[0]:
                j += 1
            k = j
            while k < len(b) and b[k][0] < x[1]:
                links.append((x[2], b[k][2]))
                k += 1
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if before < e <= c) for side in spans))
            before = c
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        linked.append(links)
        out.append([doc_id, len(a), len(b), len(cuts), len(links), digest])
    count = Counter(x for links in linked for x in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((*o[:5], sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), o[5]) for o, links in zip(out, linked)), key=str), count


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def texts():
    rng = random.Random(5)
    return [
        *(t if t is None or len(t) < 20_000 else t[:4000] for t in awkward(rng)), "<|endoftext|> and </s><s> <unk>", "▁ a piece's own space", "a▁b", " leads", "trails ",
        "tabs\tand\r\nlines\n\n", "naïve café Привет 日本語 👩‍👩‍👧 ́", "I'm we'll they'd", "\x00 null", "<0x41>", "x" + " " * 3000 + "y", "　wide", prose(rng, 300, 90),
    ]


def test_equals_a_plain_version(spark, plain_tokens):
    rows = list(enumerate(texts()))
    docs = documents(spark, [t for _, t in rows])
    want, count = plain(rows, plain_tokens)
    assert rows_of(alignment.report(docs, queries.BYTE_LEVEL, queries.PIECES)) == want
    found = {(r.first_id, r.second_id): r.links for r in alignment.pairs(docs, queries.BYTE_LEVEL, queries.PIECES).collect()}
    assert found == dict(count)


def test_blocks_make_no_difference(spark, plain_tokens, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 500)
    rng = random.Random(9)
    held = [prose(rng, rng.randrange(60), 30) for _ in range(80)]
    rows = [(None if i % 11 == 0 else i % 50, t) for i, t in enumerate([*held, *held[:20]])]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    assert rows_of(alignment.report(docs, queries.BYTE_LEVEL, queries.PIECES)) == plain(rows, plain_tokens)[0]


def test_nothing_to_align(spark):
    zero = (0, 0, 0, 0, 0, 0, "")
    docs = documents(spark, [None, "", "▁"])
    assert rows_of(alignment.report(docs, queries.BYTE_LEVEL, queries.PIECES)) == [(i, *zero) for i in range(3)]
    assert alignment.report(documents(spark, []), queries.BYTE_LEVEL, queries.PIECES).count() == 0


def test_encoder_by_rank_equals_the_library():
    with open(queries.BYTE_LEVEL, encoding="utf-8") as f:
        a = alignment.ByteLevel(f.read())
    assert a.ranked is not None
    for t in [*filter(None, texts()), " " * 100_000, "x" + "\n" * 5000]:
        assert a.encode(t) == a.own.encode(t, add_special_tokens=False).ids


def test_whole_table(spark, sf_dir, plain_tokens):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.op12_token_alignment(spark, sf_dir)) == plain(rows, plain_tokens)[0]
