import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import canonical, retrieval
from corpusloom.operators.retrieval import Bm25Index

TOY = ["The quick brown fox jumps over the lazy dog", "The lazy dog is brown", "The fox is brown", "quick quick brown"]


def index(spark, docs):
    return Bm25Index(spark.createDataFrame([(i, d.split()) for i, d in enumerate(docs)], "doc_id long, terms array<string>"))


def asked(spark, texts):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "query_id long, terms array<string>")


def plain_scores(docs, query, k1=1.5, b=0.75):
    import math

    docs = [d.split() for d in docs]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        s = 0.0
        for t in query.split():
            df = sum(t in x for x in docs)
            f = d.count(t)
            s += math.log((n - df + 0.5) / (df + 0.5) + 1) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / mean))
        out.append(s)
    return out


def test_scores_follow_the_formula_and_repeats_count(spark):
    for query in ("quick brown", "quick quick fox", "nothing"):
        want = plain_scores(TOY, query)
        got = {r.doc_id: r.score for r in retrieval.scores(index(spark, TOY), asked(spark, [query])).collect()}
        assert all(abs(got.get(i, 0.0) - w) < 1e-9 for i, w in enumerate(want))


def test_both_ways_to_the_best_document_agree(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    docs = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(60)]
    queries = [" ".join(rng.choices([*words, "new"], k=rng.randint(0, 5))) for _ in range(20)]
    i, q = index(spark, docs), asked(spark, queries)
    one = {r.query_id: r.doc_id for r in retrieval.best_documents(i, q).collect()}
    two = {r.query_id: r.doc_id for r in retrieval.best_documents(i, q, max_queries=0).collect()}
    want = {}
    for k, text in enumerate(queries):
        s = [round(x, 9) for x in plain_scores(docs, text)]
        want[k] = s.index(max(s))
    assert one == two == want


def test_added_documents_are_found_unless_parity_is_asked(spark):
    base, more = index(spark, TOY), spark.createDataFrame([(9, ["zebra"])], "doc_id long, terms array<string>")
    q = asked(spark, ["zebra"])
    assert retrieval.best_documents(base.added(more), q).first().doc_id == 9
    frozen = base.added(more, parity=True)
    assert retrieval.scores(frozen, q).count() == 0
    assert {r.term: r.df for r in frozen.frequencies().collect()}["zebra"] == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=6), min_size=2, max_size=12), st.sampled_from([0.3, 0.5, 0.8]))
def test_jaccard_pairs_are_all_pairs_above_the_limit(spark, sets, limit):
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id long, l array<string>")
    got = {(r.a, r.b): r.jaccard for r in retrieval.jaccard_pairs(retrieval.line_sets(df, F.col("l")), limit).collect()}
    want = {}
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            a, b = set(x), set(sets[j])
            if len(a & b) / len(a | b) > limit:
                want[i, j] = len(a & b) / len(a | b)
    assert got == want


def test_containment_counts_repeats_on_the_left(spark):
    c = spark.range(1).select(retrieval.containment(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("a"), F.lit("b"))).alias("c")).first().c
    assert (round(c.share, 6), c.hits, c.n) == (0.666667, 2, 3)


def test_image_difference(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    row = spark.range(1).select(
        retrieval.difference(a(1, 2, 3, 4), a(1, 2, 3, 5)).alias("d"), retrieval.difference(a(1), a(1, 2)).alias("shape"), retrieval.same_image(a(1, 2, 3, 4), a(1, 2, 3, 5)).alias("s")
    ).first()
    assert (row.d, row["shape"], row.s) == (0.25, None, True)


def test_canonical_pages_in_order_of_arrival(spark):
    pages = [  # parent, lines
        (None, ["a", "b", "c"]), (0, ["a", "b", "c"]), (1, ["x", "y", "z"]), (2, ["a", "b", "d"]), (3, ["q"]),
    ]
    rows = [("app", i, p, i, lines, None) for i, (p, lines) in enumerate(pages)]
    df = spark.createDataFrame(rows, "app string, page_id long, parent_id long, seq long, lines array<string>, image array<int>")
    got = {r.page_id: r.unique_id for r in canonical.online(df, "app", limit=0.4).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}
    again = {r.page_id: r.unique_id for r in canonical.online(df, "app", limit=0.4).collect()}
    assert all(again[u] == u for u in again.values())


def test_images_can_keep_pages_apart(spark):
    rows = [("app", 0, None, 0, ["a"], [1, 1, 1]), ("app", 1, 0, 1, ["a"], [2, 2, 2]), ("app", 2, 0, 2, ["a"], [1, 1, 1])]
    df = spark.createDataFrame(rows, "app string, page_id long, parent_id long, seq long, lines array<string>, image array<int>")
    assert {r.page_id: r.unique_id for r in canonical.online(df, "app").collect()} == {0: 0, 1: 1, 2: 0}


def test_offline_takes_the_first_or_with_parity_the_last(spark):
    rows = [("app", 0, 0, ["a", "b"]), ("app", 1, 1, ["a", "c"]), ("app", 2, 2, ["a"])]
    df = spark.createDataFrame(rows, "app string, page_id long, seq long, lines array<string>")
    assert {r.page_id: r.unique_id for r in canonical.offline(df, "app").collect()}[2] == 0
    assert {r.page_id: r.unique_id for r in canonical.offline(df, "app", parity=True).collect()}[2] == 1


def test_ids_of_any_type_both_ways(spark):
    docs = [("d3", "a b a"), ("d1", "a b a"), ("d2", "c"), ("d0", "")]
    asked = [("q1", "a"), ("q2", "c c"), ("q3", "zz"), ("q4", "a c b")]
    split = F.filter(F.split("t", " "), lambda w: w != "")
    index = retrieval.Bm25Index(spark.createDataFrame(docs, "doc_id string, t string").repartition(3).select("doc_id", split.alias("terms")))
    queries = spark.createDataFrame(asked, "query_id string, t string").select("query_id", split.alias("terms"))
    ways = [{r.query_id: (r.doc_id, round(r.score, 6)) for r in retrieval.best_documents(index, queries, max_queries=most).collect()} for most in (100, 0)]
    assert ways[0] == ways[1] and {q: d for q, (d, _) in ways[0].items()} == {"q1": "d1", "q2": "d2", "q3": "d0", "q4": "d2"}
