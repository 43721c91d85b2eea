"""Retrieval, similarity and dedup over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import kept_lines, lines, words
from corpusloom.operators import canonical, retrieval
from corpusloom.operators.retrieval import Bm25Index
from corpusloom.plans.catalog import query, spread, table

_WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
_LINES = r"regexp_split_to_array(regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '\n')"


def _index(spark: SparkSession, sf_dir: str, terms=words) -> Bm25Index:
    return Bm25Index(spread(table(spark, sf_dir, "documents")).select("doc_id", terms(F.col("text")).alias("terms")))


def _queries(spark: SparkSession, sf_dir: str, terms=words) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), terms(F.col("text")).alias("terms"))


_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"


def _bm25_sql(terms: str) -> str:
    return f"""
with d as (select doc_id, {terms} as terms from documents),
t as (select doc_id, len(terms) as len, unnest(terms) as term from d),
tf as (select doc_id, len, term, count(*) as tf from t group by all),
df as (select term, count(*) as df from tf group by term),
c as (select count(*) as n, avg(len(terms)) as avgdl from d),
q as (select item_id as query_id, unnest({terms}) as term from benchmark),
qtf as (select query_id, term, count(*) as qtf from q group by all),
s as (
  select query_id, doc_id, round(sum(qtf * {_IDF} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) as score
  from qtf join df using (term) join tf using (term), c group by all
  union all select item_id, (select min(doc_id) from documents), 0.0 from benchmark
)
select query_id, doc_id, round(score, 6) as score from s
qualify row_number() over (partition by query_id order by score desc, doc_id) = 1
"""


@query(f"""
with d as (select doc_id, {_WORDS} as terms from documents),
t as (select distinct doc_id, unnest(terms) as term from d),
df as (select term, count(*) as df from t group by term), c as (select count(*) as n from d)
select term, df, round({_IDF}, 6) as idf from df, c
""")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).idf().withColumn("idf", F.round("idf", 6))


@query(_bm25_sql(_WORDS))
def bm25_best_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best_documents(_index(spark, sf_dir), _queries(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_bm25_sql(r"regexp_extract_all(text, '[^\n]*\n|[^\n]+')"))
def bm25_line_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as terms, by the inverted-index join."""
    found = retrieval.best_documents(_index(spark, sf_dir, kept_lines), _queries(spark, sf_dir, kept_lines), max_queries=0)
    return found.withColumn("score", F.round("score", 6))


@query(f"""
with a as (select {_WORDS} as terms from documents union all select {_WORDS} from benchmark),
t as (select row_number() over () as id, terms from a), u as (select distinct id, unnest(terms) as term from t),
df as (select term, count(*) as df from u group by term), c as (select count(*) as n from a)
select term, df, round({_IDF}, 6) as idf from df, c
""")
def bm25_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after the benchmark texts have been added as documents."""
    more = _queries(spark, sf_dir).select((-1 - F.col("query_id")).alias("doc_id"), "terms")
    return _index(spark, sf_dir).added(more).idf().withColumn("idf", F.round("idf", 6))


@query(f"""
with d as (select doc_id, list_distinct({_LINES}) as lines from documents),
t as (select doc_id, len(lines) as n, unnest(lines) as line from d),
p as (select x.doc_id as a, y.doc_id as b, x.n as na, y.n as nb, count(*) as common
      from t x join t y on x.line = y.line and x.doc_id < y.doc_id group by all)
select a, b, common, round(common / (na + nb - common), 6) as jaccard from p where common / (na + nb - common) > 0.5
""")
def line_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = retrieval.line_sets(spread(table(spark, sf_dir, "documents")), lines(F.col("text")))
    return retrieval.jaccard_pairs(sets, 0.5).select("a", "b", "common", F.round("jaccard", 6).alias("jaccard"))


@query(f"""
with d as (select doc_id, list_distinct({_LINES}) as lines from documents),
c as (select md5(array_to_string(list_sort(lines), chr(10))) as cls, min(doc_id) as class_id, count(*) as copies, any_value(lines) as lines from d group by cls),
t as (select class_id, copies, len(lines) as n, unnest(lines) as line from c),
p as (select x.class_id, y.copies, x.n as na, y.n as nb, y.class_id as other, count(*) as common from t x join t y on x.line = y.line and x.class_id <> y.class_id group by all),
o as (select class_id, sum(copies) as others from p where common / (na + nb - common) > 0.5 group by class_id)
select d.doc_id, c.class_id, c.copies, cast(c.copies - 1 + coalesce(o.others, 0) as bigint) as linked
from d join c on c.cls = md5(array_to_string(list_sort(d.lines), chr(10))) left join o using (class_id)
""")
def line_jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of equal line sets, and how many others are like it, without a row per pair."""
    return retrieval.jaccard_classes(retrieval.line_sets(spread(table(spark, sf_dir, "documents")), lines(F.col("text"))), 0.5)


@query(f"""
with d as (select doc_id, source, {_LINES} as lines from documents),
f as (select source, min(doc_id) as saved from d group by source),
p as (select d.doc_id, f.saved, d.lines as code, s.lines as held from d join f using (source) join d s on s.doc_id = f.saved),
h as (select doc_id, saved, len(code) as n, len(list_filter(code, lambda x: list_contains(held, x))) as hits, len(held) as m from p)
select doc_id, saved, n, hits, round(hits / n, 6) as share, round(hits / m, 6) as back from h
""")
def line_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document its source's first document holds."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "source", lines(F.col("text")).alias("code"))
    first = docs.groupBy(F.col("source").alias("s")).agg(F.min_by(F.struct(F.col("doc_id").alias("saved"), F.col("code").alias("held")), "doc_id").alias("f"))
    c = retrieval.containment(F.col("f.held"), F.col("code"))
    met = docs.join(first, F.col("source") == F.col("s")).select("doc_id", "f.saved", c.alias("c"))
    return met.select("doc_id", "saved", F.col("c.n").alias("n"), F.col("c.hits").alias("hits"), F.round("c.share", 6).alias("share"), F.round("c.back", 6).alias("back"))


@query("select text, min(doc_id) as doc_id, count(*) as copies from documents group by text")
def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-preserving dedup: the first document of each text."""
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.lit(None).cast("array<int>").alias("image")
    docs = table(spark, sf_dir, "documents")
    parent = F.when(F.col("doc_id") >= 20, F.col("doc_id") - 20).alias("parent_id")
    return docs.select("source", F.col("doc_id").alias("page_id"), parent, F.col("doc_id").alias("seq"), lines(F.col("text")).alias("lines"), image)


@query()
def canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.online(_pages(spark, sf_dir), "source")


@query(f"""
with recursive d as (
  select source, doc_id, row_number() over (partition by source order by doc_id) as k, {_LINES} as lines from documents
), t as (select source, k, len(lines) as total, unnest(lines) as line from d),
n as (select source, k, total, line, count(*) as n from t group by all),
held as (
  select x.source, x.k as a, y.k as b from n x join n y on x.source is not distinct from y.source and x.line = y.line and y.k < x.k
  group by x.source, x.k, x.total, y.k having sum(x.n) / x.total > 0.9
), by_page as (select source, a, list(b) as bs from held group by source, a),
walk(source, k, canon, pick) as (
  select distinct source, 0::bigint, []::bigint[], 0::bigint from d
  union all
  select source, k, case when hit is null then list_append(canon, k) else canon end, coalesce(hit, k) from (
    select w.source, d.k, w.canon, list_min(list_intersect(p.bs, w.canon)) as hit
    from walk w join d on d.source is not distinct from w.source and d.k = w.k + 1 left join by_page p on p.source is not distinct from d.source and p.a = d.k
  )
)
select w.source as app, d.doc_id as page_id, c.doc_id as unique_id
from walk w join d on d.source is not distinct from w.source and d.k = w.k join d c on c.source is not distinct from w.source and c.k = w.pick
""")
def canonical_pages_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page and the first canonical page of its app that holds nine tenths of its lines."""
    return canonical.offline(_pages(spark, sf_dir), "source")


@query("""
with f as (select label, min(vec_id) as first_id from embeddings group by label),
p as (select e.vec_id, f.first_id, e.embedding as a, g.embedding as b from embeddings e join f using (label) join embeddings g on g.vec_id = f.first_id)
select vec_id, first_id, round(1 - len(list_filter(list_zip(a, b), lambda z: z[1] = z[2])) / len(a), 6) as differs,
       1 - len(list_filter(list_zip(a, b), lambda z: z[1] = z[2])) / len(a) < 0.3 as same
from p
""")
def vector_diff_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise difference from the first vector with the same label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy(F.col("label").alias("l")).agg(F.min_by(F.struct(F.col("vec_id").alias("first_id"), F.col("embedding").alias("b")), "vec_id").alias("f"))
    met = e.join(F.broadcast(first), F.col("label") == F.col("l")) if first.count() <= 10_000 else e.join(first, F.col("label") == F.col("l"))
    a, b = F.col("embedding"), F.col("f.b")
    return met.select("vec_id", "f.first_id", F.round(retrieval.difference(a, b), 6).alias("differs"), retrieval.same_image(a, b).alias("same"))


@query("""
select d.doc_id, d.lang, d.source from documents d
where not exists (select 1 from benchmark b where contains(d.text, b.text))
""")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text as a whole.

    A text can only be held where its longest line-free run of words is, so candidates come from an equi-join on a
    5-word window of each benchmark text and are then verified; benchmark texts of fewer words are
    compared directly.
    """
    docs = spread(table(spark, sf_dir, "documents"))
    bench = table(spark, sf_dir, "benchmark").filter("text is not null").select("text").distinct()
    w = words(F.col("text"))
    # The first and last word of a benchmark text may be part of longer words in a document; inner ones may not.
    inner = bench.withColumn("w", w).withColumn("key", F.when(F.size("w") >= 7, F.concat_ws(" ", F.slice("w", 2, 5))))
    five = docs.select("doc_id", w.alias("w")).filter(F.size("w") >= 5)
    grams = five.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.concat_ws(" ", F.slice("w", i, 5))))).alias("key"))
    keyed = inner.filter("key is not null").select("key", F.col("text").alias("held"))
    # A held-out set within the bound is broadcast, so the documents' windows are not shuffled.
    keyed = F.broadcast(keyed) if keyed.count() <= 20_000 else keyed
    maybe = grams.join(keyed, "key").select("doc_id", "held").distinct()
    hits = maybe.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "held")).select("doc_id")
    short = inner.filter("key is null").select(F.col("text").alias("held"))
    if not short.isEmpty():
        # Texts of under seven words may stand inside a document's words, which no equi-join on words finds: all
        # documents look for them, in parts of a bounded size.
        part = F.pmod(F.xxhash64("held"), F.lit(short.count() // 1000 + 1))
        parts = short.groupBy(part.alias("part")).agg(F.collect_list("held").alias("helds"))
        looked = docs.crossJoin(parts) if short.count() > 1000 else docs.crossJoin(F.broadcast(parts))
        hits = hits.union(looked.filter(F.exists("helds", lambda h: F.contains(F.col("text"), h))).select("doc_id"))
    return docs.join(hits.distinct(), "doc_id", "left_anti").select("doc_id", "lang", "source")
