"""Exact dedup and mixing against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, mixing
from tests.llm.fixtures import awkward, documents, prose

WS = re.compile("[\x20\x09-\x0d]")


def plain_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WS.sub("", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    best = {k: min(g)[3] for k, g in groups.items()}
    return sorted(
        (str(i), str(best[k]), len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for i, t in rows for k in [WS.sub("", t or "")]
    )


@pytest.mark.parametrize("slots", [2, 1024])
def test_dedup_equals_plain_grouping(spark, slots):
    rng = random.Random(2)
    texts = awkward(rng) + ["hot\tcopy"] * 40 + ["hot copy "] * 3 + [prose(rng, 9) for _ in range(30)]
    ids = list(range(len(texts)))
    docs = documents(spark, texts, ids)
    got = exact_dedup.decisions(docs, heavy_slots=slots).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.digest) for r in got) == plain_dedup(list(zip(ids, texts)))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    left = exact_dedup.keep_first(docs, heavy_slots=slots)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({r.keep_id for r in got})


def test_dedup_of_repeated_rows_and_null_ids_keeps_one(spark):
    docs = documents(spark, ["same", "same", "same", "other", "other", "a b", "a  b"], [1, 1, None, None, None, 3, 2])
    got = exact_dedup.decisions(docs).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 3
    assert {r.keep_id for r in got if r.group_size == 3} == {1}
    left = sorted(str(r.doc_id) for r in exact_dedup.keep_first(docs).collect())
    assert left == ["1", "2", "None"]


def test_report_columns(spark):
    r = exact_dedup.report(documents(spark, ["A b"])).first()
    assert r.asDict() == {"doc_id": 0, "keep_id": 0, "group_size": 1, "kept": True, "text_sha256": hashlib.sha256(b"Ab").hexdigest()}


def test_empty_tables(spark):
    docs = documents(spark, ["x"]).filter("false")
    assert exact_dedup.report(docs).count() == exact_dedup.keep_first(docs).count() == 0
    assert mixing.report(docs).count() == mixing.mix(docs).count() == 0


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


def test_mixing_meets_targets_and_repeats_itself(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([1, 3, 10, 60])) for _ in range(400)] + awkward(rng)
    sources = [rng.choice(["hot", "hot", "hot", "a", "b", "c", "é", None]) for _ in texts]
    docs = documents(spark, texts, sources=sources)
    one = {r.doc_id: r for r in mixing.report(docs).collect()}
    two = {r.doc_id: r.taken for r in mixing.report(docs.repartition(7)).collect()}
    assert {k: r.taken for k, r in one.items()} == two and len(one) == len(texts)
    count = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]
    assert all(one[i].size == c for i, c in enumerate(count))
    sizes, taken, largest = {}, {}, {}
    for i, s in enumerate(sources):
        sizes[s] = sizes.get(s, 0) + count[i]
        taken[s] = taken.get(s, 0) + one[i].taken
        largest[s] = max(largest.get(s, 0), count[i])
    want = plain_targets(sizes)
    for i, s in enumerate(sources):
        assert one[i].source_size == sizes[s] and abs(one[i].target - want[s]) < 1e-6 * max(want[s], 1)
        assert one[i].taken in (0, count[i], 2 * count[i])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(copies.get(i, 0) * count[i] == one[i].taken for i in one)


def test_mixing_of_ties_blanks_and_null_ids(spark):
    docs = documents(spark, ["a b c"] * 6 + [None, ""], [1, 1, 1, None, None, 2, 3, None], ["s"] * 4 + ["t"] * 2 + [None, "u"])
    got = mixing.report(docs).collect()
    assert len(got) == 8 and {r.taken % 3 for r in got} == {0} and all(r.taken <= 2 * r.size for r in got)
    assert all(r.target == 0 for r in got if r.size == 0)
    blank = mixing.report(documents(spark, [None, " "])).collect()
    assert [r.target for r in blank] == [0, 0]


def test_salted_join_gives_the_same(spark):
    from corpusloom.llm.common import small_join

    big = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    small = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    one = {tuple(r) for r in small_join(big, small, ["k"], "inner", 3).select("k", "id", "v").collect()}
    two = {tuple(r) for r in small_join(big, small, ["k"], "inner", 10**9).select("k", "id", "v").collect()}
    assert one == two and len(one) == 100
