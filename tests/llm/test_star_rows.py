"""Rows that the way from keys to links makes: none for pairs that fail the cheap test, none twice for keys of the same classes."""

import random

import pytest

from corpusloom.llm import minhash, near_links, ngram_join
from tests.llm.fixtures import documents, prose


def counted(monkeypatch):
    rows, plain = [], near_links.stash

    def stash(df, tag):
        out = plain(df, tag)
        rows.append((tag, set(out.columns), out.count()))
        return out

    monkeypatch.setattr(near_links, "stash", stash)
    return rows


@pytest.mark.parametrize("operator", [minhash, ngram_join])
def test_no_rows_for_unlike_members_of_a_group(spark, monkeypatch, operator):
    rng = random.Random(6)
    common = prose(rng, 200, 5000)
    texts = [f"{common} {prose(rng, 100, 10**6)}" for _ in range(60)]  # each two share half of their shingles
    rows = counted(monkeypatch)
    got = {r.doc_id: r.component_id for r in operator.report(documents(spark, texts)).collect()}
    assert got == {i: i for i in range(60)}
    assert max(n for tag, _, n in rows if tag == "members") > 60  # they meet in keys
    assert sum(n for _, columns, n in rows if columns == {"u", "v"}) <= 60


@pytest.mark.parametrize("operator", [minhash, ngram_join])
def test_keys_of_the_same_classes_are_one(spark, monkeypatch, operator):
    base = prose(random.Random(7), 200, 5000)
    rows = counted(monkeypatch)
    got = {r.doc_id: r.component_id for r in operator.report(documents(spark, [base, base + " end", base + " END"])).collect()}
    assert got == {0: 0, 1: 0, 2: 0}
    assert max(n for tag, _, n in rows if tag == "members") == 2
