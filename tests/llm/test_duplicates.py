"""Near-dedup and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import components, minhash, near_links, ngram_join, suffix_array, suffix_dedup
from corpusloom.llm.components import connected
from tests.llm.fixtures import awkward, documents, prose


def plain_sets(texts, n=2):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        yield frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_components(ids, sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(ids))]


def near(rng, text, share):
    return " ".join(w if rng.random() > share else f"n{rng.randrange(10**6)}" for w in text.split())


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    rng = random.Random(3)
    base = [prose(rng, 150, 3000) for _ in range(6)]
    base += [prose(rng, n, 3000) for n in (6, 9, 11)]  # small sets, at the threshold with one word more
    texts = awkward(rng) + base + [f"{b} end" for b in base] + [near(rng, b, rng.choice([0.01, 0.03, 0.05, 0.08, 0.12])) for b in base for _ in range(14)] + [base[0]] * 5
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = documents(spark, texts, ids)
    sets = list(plain_sets(texts, words))
    got = {r.doc_id: r for r in minhash.report(docs, words).collect()}
    want = plain_components(ids, sets)
    assert [got[i].n_shingles for i in ids] == [len(s) for s in sets]
    assert [got[i].component_id for i in ids] == want
    assert all(got[i].kept == (i == w) for i, w in zip(ids, want))
    kept = minhash.keep_one(docs, words)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    empty = documents(spark, ["x"]).filter("false")
    assert minhash.report(empty).count() == minhash.keep_one(empty).count() == 0
    got = minhash.report(documents(spark, ["a b", "a b", None, "c"], [None, 5, None, 6])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "5", True), ("6", "6", True), ("None", "5", False), ("None", "None", True)]


def test_estimate_is_near_the_similarity(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = x[:3600], x[400:]
    sig = [minhash._signature(minhash._minima(s))[0].tolist() for s in (a, b)]
    df = spark.createDataFrame([tuple(sig)], "a array<long>, b array<long>")
    assert abs(df.select(minhash.estimate(F.col("a"), F.col("b")).alias("e")).first().e - 3200 / 4000) < 0.1


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 4), st.sampled_from([2, 2048]))
def test_suffix_arrays_and_common_prefixes(values, least, buckets):
    text = np.array(values * (1 + least % 2), np.int16)
    suffix_array.MAX_BUCKETS, before = buckets if buckets > 4 else 4, suffix_array.MAX_BUCKETS
    try:
        order = suffix_array.suffix_array(text, 4)
    finally:
        suffix_array.MAX_BUCKETS = before
    v = text.tolist()
    want = sorted(range(len(v)), key=lambda i: v[i:])
    assert order.tolist() == want
    value, phi = suffix_array.common_prefixes(text, order, least)
    for one, two in zip(want[1:], want):
        n = 0
        while max(one, two) + n < len(v) and v[one + n] == v[two + n]:
            n += 1
        assert phi[one] == two and (value[one] == n if n >= least else value[one] < least)


def plain_removal(texts, length=400):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                covered[k : k + length] = True
        edge = np.diff(np.append(0, covered.astype(int)))
        kept = bytes(b for b, c in zip(t, covered) if not c)
        out.append((len(t), int(covered.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 2048])
def test_suffix_dedup_equals_brute_force(spark, hot, monkeypatch):
    rng = random.Random(8)
    shared = prose(rng, 130)
    edge = shared[:399]
    texts = awkward(rng) + [f"{prose(rng, rng.randrange(60))} {shared} {prose(rng, 30)}" for _ in range(12)]
    texts += [prose(rng, 50) + edge, prose(rng, 50) + edge, shared[:400] + "é", "q" + shared[:400], shared + shared, "ab" * 450, "abc" * 133 + "x"]
    plain = suffix_dedup.repeats
    monkeypatch.setattr(suffix_dedup, "repeats", lambda docs: plain(docs, hot))
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in suffix_dedup.report(docs).collect()}
    for i, want in enumerate(plain_removal(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, (i, want[:3])
    if hot > 1:
        cut = suffix_dedup.remove(docs)
        assert cut.columns == docs.columns
        left = {r.doc_id: r.text for r in cut.collect()}
        assert left[0] is None and all(len((left[i] or "").encode()) <= got[i].n_bytes - got[i].n_removed for i in left)


def test_giant_texts_are_cut_without_losing_windows(spark, monkeypatch):
    rng = random.Random(9)
    shared = prose(rng, 200)
    texts = [prose(rng, 900, 10**6) + shared + prose(rng, 300, 10**6), prose(rng, 400, 10**6) + shared]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    spans = {}
    for i, _, _, start, n in suffix_dedup.segments([t.encode() for t in texts]):
        for a, b, c in zip(i, start, n):
            spans.setdefault(int(a), []).extend(range(b, b + c))
    assert {i: sorted(s) for i, s in spans.items()} == {i: list(range(len(t.encode()) - 399)) for i, t in enumerate(texts)}


def test_suffix_dedup_of_nothing_and_of_repeated_rows(spark):
    assert suffix_dedup.report(documents(spark, ["x"]).filter("false")).count() == 0
    text = prose(random.Random(1), 200)
    got = suffix_dedup.report(documents(spark, [text, text, None], [1, 1, None])).collect()
    assert sorted((r.n_removed, r.n_spans) for r in got) == [(0, 0), (len(text), 1), (len(text), 1)]


@pytest.mark.parametrize("operator", [minhash, ngram_join])
def test_a_large_key_is_split_and_loses_no_link(spark, monkeypatch, operator):
    """Stars that link nothing, so that every link is found across components, in keys of many parts."""
    monkeypatch.setattr(near_links, "SPLIT", 3)
    stars = near_links.stars
    monkeypatch.setattr(near_links, "stars", lambda open_: stars(open_).filter("false"))
    rng = random.Random(5)
    base = prose(rng, 200, 5000)
    texts = [near(rng, base, rng.choice([0.0, 0.02, 0.05, 0.1])) for _ in range(40)] + [base + " " + prose(rng, n) for n in range(0, 60, 7)]
    got = {r.doc_id: r.component_id for r in operator.report(documents(spark, texts), 2).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(list(range(len(texts))), list(plain_sets(texts)))


def cancelling(n):
    """Two texts of 2**n letters that sums of powers of an odd base cannot tell apart modulo powers of two."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("operator", [minhash, ngram_join])
def test_words_made_to_cancel_are_different(spark, operator):
    x, y = cancelling(10)
    got = {r.doc_id: r for r in operator.report(documents(spark, [x, y, f"{x} {y} {x}", f"{y} {x} {y}"]), 2).collect()}
    assert [got[i].component_id for i in range(4)] == [0, 1, 2, 2]
    assert [got[i].n_shingles for i in range(4)] == [1, 1, 2, 2]


def test_near_copies_without_ids(spark):
    def kept(texts, ids):
        return sorted(((r.doc_id, r.text) for r in minhash.keep_one(documents(spark, texts, ids)).collect()), key=str)

    t = prose(random.Random(2), 80)
    assert kept([t, t, ""], [1, None, None]) == [(1, t), (None, "")]
    assert kept([t, t + " end", t.upper(), " ", None], [None] * 5) in (sorted([(None, " "), (None, None), (None, x)], key=str) for x in (t, t + " end", t.upper()))
    assert kept([t, t], [None, None]) == [(None, t), (None, t)]  # equal rows share their flags
    assert kept(["a b", "c d", "e f"], [None, None, 3]) == [(3, "e f"), (None, "a b"), (None, "c d")]


def test_hot_stars_keys_and_centres_are_split(spark, monkeypatch):
    """With every join split, one star of many members and a path give the same components."""
    for module in (components, near_links):
        monkeypatch.setattr(module, "frequent_from", lambda rows: 3)
    monkeypatch.setattr(components, "FEW", 0)
    monkeypatch.setattr("corpusloom.llm.common.FEW", 0)
    monkeypatch.setattr("corpusloom.llm.common.FREQUENT", 20)
    edges = spark.createDataFrame([(500, i) for i in range(100)] + [(i, i + 1) for i in range(600, 620)], "u long, v long")
    assert {r.node: r.root for r in connected(edges).collect()} == {i: 0 for i in [*range(1, 100), 500]} | {i: 600 for i in range(601, 621)}
    rng = random.Random(8)
    base = prose(rng, 100, 5000)
    texts = [near(rng, base, 0.01) for _ in range(60)] + [prose(rng, 60, 5000) for _ in range(20)]
    want = plain_components(list(range(len(texts))), list(plain_sets(texts, 5)))
    for operator in (minhash, ngram_join):
        got = {r.doc_id: r.component_id for r in operator.report(documents(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == want
