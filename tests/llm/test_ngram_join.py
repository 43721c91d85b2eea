"""PartEnum signatures and the join on them, against all pairs."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import ngram_join, queries
from tests.llm.fixtures import awkward, documents, prose
from tests.llm.test_duplicates import near, plain_components, plain_sets


def linked_sets(size, other, rng):
    """Two sorted sets of these sizes that just reach the threshold."""
    both = -(-80 * (size + other) // 180)
    pool = rng.integers(0, 2**63, size + other - both, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.sort(pool[:size]), np.sort(np.append(pool[:both], pool[size:]))


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 900), st.floats(0.8, 1), st.integers(0, 2**32))
def test_linked_sets_share_a_key(size, ratio, seed):
    other = max(1, -(-int(size * ratio * 1000) // 1000))
    if other * 100 < size * 80:
        other = -(-size * 80 // 100)
    a, b = linked_sets(size, other, np.random.default_rng(seed))
    both = len(np.intersect1d(a, b))
    if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
        return
    schemes = ngram_join.Schemes()
    assert len(np.intersect1d(schemes.keys(a), schemes.keys(b)))
    odd = [np.unpackbits(ngram_join.parities(s).view(np.uint8)) for s in (a, b)]
    assert (odd[0] != odd[1]).sum() <= len(a) + len(b) - 2 * both <= ngram_join.differing(len(a), len(b))


@pytest.mark.parametrize("size", [6, 15, 30, 80, 400, 3000])
def test_few_keys_and_few_strangers(size):
    """No more keys than three a shingle, and sets with nothing in common share none."""
    schemes, rng = ngram_join.Schemes(), np.random.default_rng(size)
    sets = [np.sort(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)) for _ in range(40)]
    keys = [schemes.keys(s) for s in sets]
    assert max(map(len, keys)) <= 3 * size
    assert len(np.unique(np.concatenate([np.unique(k) for k in keys]))) == sum(len(np.unique(k)) for k in keys)


def test_bands_leave_no_size_out():
    at = 1
    for low, high in ngram_join.BANDS:
        assert low == at and high >= low
        at = high + 1


def test_equals_all_pairs(spark):
    rng = random.Random(11)
    base = [prose(rng, n, 3000) for n in (5, 6, 8, 9, 10, 12, 17, 23, 31, 44, 60, 90, 140, 200, 420)]
    texts = awkward(rng) + base + [near(rng, b, rng.choice([0.005, 0.02, 0.03, 0.05])) for b in base for _ in range(8)]
    texts += [b + " " + prose(rng, n, 3000) for b in base for n in (1, 2, len(b.split()) // 5)] + base[:6]
    passage = prose(rng, 50)
    texts += [f"{prose(rng, 60, 5000)} {passage} {prose(rng, 60, 5000)}" for _ in range(25)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = documents(spark, texts, ids)
    sets = list(plain_sets(texts, 5))
    got = {r.doc_id: r for r in ngram_join.report(docs).collect()}
    assert [got[i].n_shingles for i in ids] == [len(s) for s in sets]
    assert [got[i].component_id for i in ids] == plain_components(ids, sets)
    members, found = ngram_join.links(docs)
    node = {r.doc_id: bytes(r.node) if r.node else None for r in members.collect()}
    of = dict(zip(ids, sets))
    linked = [tuple(sorted((bytes(r.u), bytes(r.v)))) for r in found.collect()]
    want = {tuple(sorted((node[i], node[j]))) for i in ids for j in ids if i < j and of[i] and of[j] and of[i] != of[j] and 100 * len(of[i] & of[j]) >= 80 * len(of[i] | of[j])}
    assert len(linked) == len(set(linked)) and set(linked) == want


def test_nothing_and_null_ids(spark):
    assert ngram_join.report(documents(spark, ["x"]).filter("false")).count() == 0
    got = ngram_join.report(documents(spark, ["a b", "a  B", None, "c", ""], [None, 5, None, 6, 7])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("5", 1, "5"), ("6", 1, "6"), ("7", 0, "7"), ("None", 0, "None"), ("None", 1, "5")]


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.execute(f"select doc_id, n_shingles, component_id from ({queries.ORACLE_SQL['op11_ngram_join']})").fetchall()
    assert sorted(map(tuple, queries.op11_ngram_join(spark, sf_dir).collect())) == sorted(want)
