"""Large sets: pairs that are no links are told apart before full sets are sent for them, and no link is lost."""

import random

from corpusloom.llm import near_links, ngram_join


def text(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_large_sets_that_are_no_links_need_no_full_sets(spark, monkeypatch):
    rng = random.Random(3)
    common, docs = text(rng, 2_600), []
    for k in range(12):  # each two of these share 0.65 of their shingles
        docs.append(common + text(rng, 700))
    base = text(rng, 4_090)
    docs += [base, base[:3_700], base[:3_400], base[:2_950], text(rng, 40)]  # 0.9, 0.92, 0.87: sizes to both sides of a power of two
    seen = []
    confirmed = near_links.confirmed
    monkeypatch.setattr(near_links, "confirmed", lambda pairs, made: seen.append(pairs.count()) or confirmed(pairs, made))
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.report(rows, 5).collect()}
    assert got == {i: 12 if 12 <= i < 16 else i for i in range(len(docs))}
    assert sum(seen) <= 6
