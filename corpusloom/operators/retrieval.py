"""BM25 over documents of terms, and line-set similarity.

Two ways give the best document of each query. Where the query side is within a checked bound, a
sparse-by-dense product per batch of documents keeps one best document per query and partition, so
what is shuffled is queries times partitions. Beyond the bound, query terms meet postings in an
inverted-index join whose tables are aggregated map-side first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.storage import written

K1, B = 1.5, 0.75
#: Decimals to which scores are rounded before they are compared, so that ties do not hang on the last bits.
DIGITS = 9
#: Bounds of the query side for the product: queries, and queries times vocabulary.
MAX_QUERIES, MAX_CELLS = 5_000, 20_000_000


@dataclass
class Bm25Index:
    """docs(doc_id, terms array<string>); counts are of the documents that the index was built from.

    extra_df holds document frequencies added later in parity mode, when documents are
    not added with them.
    """

    docs: DataFrame
    k1: float = K1
    b: float = B
    extra_df: DataFrame | None = None

    def lengths(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"))

    def frequencies(self) -> DataFrame:
        """term, df: documents that hold the term."""
        df = self.docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        if self.extra_df is None:
            return df
        return df.unionByName(self.extra_df).groupBy("term").agg(F.sum("df").alias("df"))

    def idf(self) -> DataFrame:
        """term, df, idf."""
        return self.frequencies().crossJoin(F.broadcast(self.lengths().select("n"))).select("term", "df", idf_of(F.col("n"), F.col("df")).alias("idf"))

    def added(self, more: DataFrame, parity: bool = False) -> Bm25Index:
        """The index with more documents. With parity only document frequencies grow, so the new ones cannot be found."""
        if not parity:
            return Bm25Index(self.docs.unionByName(more), self.k1, self.b)
        df = more.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        return Bm25Index(self.docs, self.k1, self.b, df)


def idf_of(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf from queries(query_id, terms): repeated terms count as often as they stand."""
    return queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score of all pairs that share a term, by an inverted-index join."""
    asked = query_terms(queries)
    vocabulary = asked.select("term").distinct()
    postings = (
        index.docs.select("doc_id", F.size("terms").alias("len"), F.explode("terms").alias("term"))
        .join(vocabulary, "term", "left_semi")  # before counting: other terms never score
        .groupBy("doc_id", "len", "term")
        .agg(F.count("*").alias("tf"))
    )
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    if index.extra_df is not None:
        df = df.join(index.extra_df.withColumnRenamed("df", "more"), "term", "left").select("term", (F.col("df") + F.coalesce("more", F.lit(0))).alias("df"))
    weighed = asked.join(df, "term").crossJoin(F.broadcast(index.lengths()))
    part = (
        F.col("qtf") * idf_of(F.col("n"), F.col("df")) * F.col("tf") * (index.k1 + 1)
        / (F.col("tf") + index.k1 * (1 - index.b + index.b * F.col("len") / F.col("avgdl")))
    )
    return postings.join(weighed, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def _best_in_batches(names: list, name_type: pa.DataType, vocabulary: list[str], weighed: list[list[tuple[int, float]]], k1: float, b: float, avgdl: float):
    """The best document of each query in a partition; weighed has, for each term, the queries that hold it and its weight there.

    A block of documents takes as many cells as it has documents times queries, and a step for each query that a counted term is in.
    """
    known = pa.array(vocabulary, pa.string())
    first = np.append(0, np.cumsum([len(w) for w in weighed]))
    query = np.array([q for w in weighed for q, _ in w], np.int64)
    weight = np.array([x for w in weighed for _, x in w])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, v = len(names), len(vocabulary)
        top = np.full(m, -1.0)
        doc: list = [None] * m
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, len(batch), 256):
                rows, ids = batch.column(1).slice(at, 256), batch.column(0).slice(at, 256).to_pylist()
                size = np.array(pc.list_value_length(rows).fill_null(0))
                code = np.array(pc.index_in(rows.flatten(), value_set=known).fill_null(-1))
                cell, tf = np.unique((np.repeat(np.arange(len(rows)), size) * v + code)[code >= 0], return_counts=True)
                row, term = cell // v, cell % v
                hit = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / avgdl))
                times = first[term + 1] - first[term]
                entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first[term], times)
                part = np.repeat(hit, times) * weight[entry]
                score = np.round(np.bincount(np.repeat(row, times) * m + query[entry], part, len(rows) * m).reshape(len(rows), m), DIGITS)
                order = sorted(range(len(ids)), key=ids.__getitem__)
                at_best = score[order].argmax(axis=0)  # the least id of those with the highest score
                high = score[order].max(axis=0)
                for q in np.flatnonzero(high >= top):
                    here = ids[order[at_best[q]]]
                    if high[q] > top[q] or here < doc[q]:
                        top[q], doc[q] = high[q], here
        seen = [q for q in range(m) if doc[q] is not None]
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[q] for q in seen], name_type), pa.array([doc[q] for q in seen], id_type), pa.array(top[seen])], ["query_id", "doc_id", "score"]
            )

    return best


def best_documents(index: Bm25Index, queries: DataFrame, max_queries: int = MAX_QUERIES, max_cells: int = MAX_CELLS) -> DataFrame:
    """query_id, doc_id, score: the best document of each query, the smallest doc_id on ties and where all score 0."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    asked = queries.select("query_id", "terms").limit(max_queries + 1).collect()  # bounded
    vocabulary = {t: i for i, t in enumerate(sorted({t for q in asked for t in q.terms}))}
    small = len(asked) <= max_queries and len(asked) * len(vocabulary) <= max_cells and len(vocabulary)
    if small:
        n, avgdl = index.lengths().first()
        # Only the vocabulary's terms are counted, picked out of each document before anything is shuffled.
        words = index.docs.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string")
        own = index.docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(F.broadcast(words), "term", "left_semi")
        frequencies = own.groupBy("term").agg(F.count("*").alias("df"))
        if index.extra_df is not None:
            frequencies = frequencies.unionByName(index.extra_df.join(F.broadcast(words), "term", "left_semi")).groupBy("term").agg(F.sum("df").alias("df"))
        df = {r.term: r.df for r in frequencies.collect()}  # no more than the vocabulary
        weighed: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
        for k, q in enumerate(asked):
            for t, m in Counter(q.terms).items():
                d = df.get(t, 0)
                weighed[vocabulary[t]].append((k, m * float(np.log((n - d + 0.5) / (d + 0.5) + 1))))
        names, name_type, id_type = [q.query_id for q in asked], queries.schema["query_id"].dataType, index.docs.schema["doc_id"].dataType
        found = index.docs.select("doc_id", "terms").mapInArrow(
            _best_in_batches(names, to_arrow_type(name_type), list(vocabulary), weighed, index.k1, index.b, avgdl or 1.0),
            f"query_id {name_type.simpleString()}, doc_id {id_type.simpleString()}, score double",
        )
    else:
        first = index.docs.agg(F.min("doc_id").alias("doc_id"))
        nothing = queries.select("query_id").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
        found = scores(index, queries).withColumn("score", F.round("score", DIGITS)).unionByName(nothing)
    return found.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def line_sets(pages: DataFrame, text: Column) -> DataFrame:
    """doc_id, lines (distinct), n from pages(doc_id, ..)."""
    distinct = F.array_distinct(text)
    return pages.select("doc_id", distinct.alias("lines"), F.size(distinct).alias("n"))


def _digests(lines: str) -> Column:
    """Lines as 128 bits each, so that what is shuffled and sorted does not hold their texts."""
    return F.transform(lines, lambda x: F.unhex(F.md5(x.cast("binary")))).alias(lines)


def jaccard_pairs(sets: DataFrame, limit: float) -> DataFrame:
    """a, b, common, jaccard of the pairs whose line sets are more alike than limit, exactly; lines are known by 128-bit digests."""
    return _alike(written(sets.select("doc_id", _digests("lines"), "n"), "digests"), limit)


def _alike(sets: DataFrame, limit: float) -> DataFrame:
    """jaccard_pairs() of sets of digests.

    Lines are ordered by how few pages hold them; a pair above the limit shares a line among the rarest
    (1 - limit) share of either set, so only those lines are joined and boilerplate lines are not
    unless they stand in such a share. Sets are compared once per candidate pair.
    """
    lines = sets.select("doc_id", "n", F.explode("lines").alias("line"))
    df = lines.groupBy("line").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = lines.join(df, "line", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    order = Window.partitionBy("doc_id").orderBy("df", "line")
    prefix = ranked.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * limit) + 1).filter("df > 1")
    p = prefix.select("doc_id", "n", "line")
    pairs = (
        p.alias("x").join(p.alias("y"), F.expr(f"x.line = y.line and x.doc_id < y.doc_id and least(x.n, y.n) > {limit} * greatest(x.n, y.n)"))
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    )
    one = sets.select(F.col("doc_id").alias("a"), F.col("lines").alias("la"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("lines").alias("lb"))
    common = F.size(F.array_intersect("la", "lb"))
    return (
        pairs.join(one, "a").join(two, "b")
        .select("a", "b", common.alias("common"), (common / (F.size("la") + F.size("lb") - common)).alias("jaccard"))
        .filter(F.col("jaccard") > limit)
    )


def jaccard_classes(sets: DataFrame, limit: float) -> DataFrame:
    """doc_id, class_id, copies, linked: jaccard_pairs() without a row per pair of copies.

    Pages with equal sets are one class, named by its least doc_id; only classes meet. linked counts the other pages that are
    more alike than limit, copies included; which they are follows from jaccard_pairs() over the classes and the membership.
    """
    keyed = sets.select("doc_id", _digests("lines"), "n").withColumn("cls", F.md5(F.to_json(F.array_sort("lines")).cast("binary")))
    classes = written(keyed.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("lines").alias("lines"), F.first("n").alias("n")), "classes")
    pairs = _alike(classes.select(F.col("class_id").alias("doc_id"), "lines", "n"), limit).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("class_id").alias("b"), "copies")
    others = both.join(sizes, "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("copies").alias("others"))
    known = classes.select("cls", "class_id", "copies", (F.col("n") > 0).alias("some")).join(others, "class_id", "left")
    own = F.when(F.col("some"), F.col("copies") - 1).otherwise(0)
    return keyed.select("doc_id", "cls").join(known, "cls").select("doc_id", "class_id", "copies", (F.coalesce("others", F.lit(0)) + own).alias("linked"))


def containment(saved: Column, code: Column) -> Column:
    """share, hits, n, back: each line of code counts as often as it stands, saved is a set."""
    hits = F.size(F.filter(code, lambda line: F.array_contains(saved, line)))
    return F.struct(
        F.coalesce(F.when(F.size(code) > 0, hits / F.size(code)), F.lit(0.0)).alias("share"),
        hits.alias("hits"),
        F.size(code).alias("n"),
        F.coalesce(F.when(F.size(saved) > 0, hits / F.size(saved)), F.lit(0.0)).alias("back"),
    )


def difference(a: Column, b: Column) -> Column:
    """Share of elements that differ; null where the shapes do."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), 1 - equal / F.size(a))


def same_image(a: Column, b: Column, threshold: float = 0.3) -> Column:
    return F.coalesce(difference(a, b) < threshold, F.lit(False))
