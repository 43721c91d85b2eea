"""Words that no longer word-initial piece begins: the bare word start, and bytes of characters of no piece."""

import random

from corpusloom.llm import queries, token_count
from tests.llm.fixtures import documents
from tests.llm.test_models_and_tokens import PIECES, odd_texts


def plain_count(word, initial, continuing, bare=True, byte_pieces=True):
    at = n = 0
    longest = max(map(len, initial | continuing))
    while at < len(word) or n == 0:
        fits = [k for k in range(1, min(longest, len(word) - at) + 1) if word[at : at + k] in (continuing if n else initial)]
        if fits:
            at, n = at + max(fits), n + 1
        elif n == 0 and bare:
            n = 1
        elif n and byte_pieces:
            at, n = at + 1, n + len(word[at].encode())
        else:
            return -1
    return n


def test_every_word_is_counted_whole(spark, tmp_path):
    first, rest = map(set, token_count.read_vocabulary(PIECES))
    assert token_count.read_fallbacks(PIECES) == (True, True)
    texts = ["2024", "24be6443" * 5, "漢字漢字漢", "ñandú ção ß", "x🙂y \U0001f9ff ▁x", *odd_texts(random.Random(21))]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_token_counts(spark, str(tmp_path)).collect()}
    assert got[0].n_tokens == 5
    for i, t in enumerate(texts):
        words = [w.decode() for w in (t or "").encode().split()]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(words), sum(plain_count(w, first, rest) for w in words), 0)


def test_small_automata_with_fallbacks_equal_plain_greedy():
    rng = random.Random(22)
    for _ in range(2000):
        some = lambda n: {"".join(rng.choices("abé", k=rng.randint(1, 4))) for _ in range(n)}
        first, rest = some(3), some(4)
        bare, byte_pieces = rng.random() < 0.7, rng.random() < 0.7
        word = "".join(rng.choices("abé漢", [4, 4, 2, 1], k=rng.randint(1, 12)))
        assert token_count.LongestMatch(first, rest, bare, byte_pieces).count(word) == plain_count(word, first, rest, bare, byte_pieces)
