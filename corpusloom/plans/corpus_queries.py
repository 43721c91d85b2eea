"""Corpus building over documents and conversations: filters, splits, statistics, samples, training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import bpe
from corpusloom.functions.text import let, simple_upper
from corpusloom.operators import corpus, graph
from corpusloom.plans.catalog import query, spread, table
from corpusloom.sources.files import decoded_twice, encoded_twice
from corpusloom.storage import small_batches

HELD_OUT = ["src1", "src7"]
MAX_LEN = 128
POOL = ["Where is {text}?", "Point to {text}.", "Find the box of {text}.", "Which element says {text}?", "Locate {text} on this page."]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("select doc_id, source, case when starts_with(source, 'src1') or starts_with(source, 'src7') then 'test' else 'train' end as split from documents")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_by_prefix(_docs(spark, sf_dir).select("doc_id", "source"), "source", HELD_OUT)


@query("""
select d.doc_id, d.source, coalesce(l.quality, 1) as quality from documents d left join labels l using (doc_id)
where length(d.text) >= 200 and coalesce(l.quality, 1) = 1 and coalesce(l.toxic, 0) = 0 and not contains(d.text, 'img>') and octet_length(encode(d.text)) >= 512
""")
def quality_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    joined = _docs(spark, sf_dir).filter(corpus.large_enough(text, F.octet_length(text)) & ~text.contains("img>")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return joined.filter(good).select("doc_id", "source", F.coalesce("quality", F.lit(1)).alias("quality"))


@query("select doc_id from documents where not contains(text, 'Licensed') and not contains(text, '@') and not contains(text, 'token')")
def keyword_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(corpus.no_keyword(F.col("text"), ["Licensed", "@", "token"])).select("doc_id")


@query("""
select source, lang, count(*) as docs, cast(sum(n_chars) as bigint) as chars, cast(sum(case when quality = 1 then 1 else 0 end) as bigint) as good,
       arg_min(substr(text, 1, 40), doc_id) as example
from documents left join labels using (doc_id) group by rollup (source, lang)
""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per source and language, with subtotals and the first document of each."""
    joined = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.rollup("source", "lang").agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.min_by(F.substring("text", 1, 40), "doc_id").alias("example"),
    )


@query("""
select source as app, count(distinct text) as unique_page_num, count(*) as all_page_num, count(distinct lang) as action_vocab, count(distinct doc_id) as page_vocab
from documents group by source
""")
def corpus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("source", "lang", "doc_id", F.md5("text").alias("t"))
    return docs.groupBy(F.col("source").alias("app")).agg(F.countDistinct("t").alias("unique_page_num"), F.count("*").alias("all_page_num"), F.countDistinct("lang").alias("action_vocab"), F.countDistinct("doc_id").alias("page_vocab"))


@query("""
with u as (select md5(text) as t, min(doc_id) as unique_id, string_agg(doc_id::varchar, ',' order by doc_id) as pages, string_agg(distinct lang, ',' order by lang) as langs from documents group by md5(text))
select unique_id, pages, langs from u
""")
def class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted index from a canonical page to its pages, and its distinct actions."""
    return (
        _docs(spark, sf_dir).groupBy(F.md5("text").alias("t"))
        .agg(F.min("doc_id").alias("unique_id"), F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("pages"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs")).drop("t")
    )


@query("""
with n as (select count(*) as n from documents), r as (select doc_id, row_number() over (order by doc_id) - 1 as k from documents)
select doc_id, cast(case when n // 7 = 0 then 6 else least(k // (n // 7), 6) end as int) as chunk from r, n
""")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven contiguous chunks, the last with the remainder."""
    docs = _docs(spark, sf_dir)
    ids = graph.first_seen_ids(docs.select("doc_id"), "doc_id", "doc_id")
    return ids.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("doc_id", graph.chunk_of(F.col("id"), F.col("n"), 7).alias("chunk"))


@query("select doc_id, source from documents order by md5('s1|' || doc_id), doc_id limit 100")
def hash_sample_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sample of 100 documents: a top-k by hash."""
    return _docs(spark, sf_dir).select("doc_id", "source").orderBy(graph.hash_order("s1", "doc_id"), "doc_id").limit(100)


@query("""
with w as (select doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''))) as word from documents)
select doc_id, word from w qualify row_number() over (partition by doc_id order by md5('s2|' || doc_id || '|' || word), word) <= 5
""")
def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five distinct words of each document, chosen by hash.

    The choice is made inside each row, by an array sort, so nothing is shuffled.
    """
    h = lambda w: F.md5(F.concat_ws("|", F.lit("s2"), F.col("doc_id").cast("string"), w))
    distinct = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    best = F.slice(F.array_sort(F.transform(distinct, lambda w: F.struct(h(w).alias("h"), w.alias("w")))), 1, 5)
    return spread(_docs(spark, sf_dir)).select("doc_id", F.explode(best).alias("b")).select("doc_id", F.col("b.w").alias("word"))


@query("""
select conv_id, cast(count(*) as int) as turns, string_agg(role, ',' order by turn) as roles, md5(string_agg(role || ':' || text, '|' order by turn)) as digest
from conversations group by conv_id
""")
def conversations_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = corpus.conversation(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    c = F.col("conversations")
    parts = F.transform(c, lambda t: F.concat(t["from"], F.lit(":"), t["value"]))
    return made.select("conv_id", F.size(c).alias("turns"), F.array_join(c["from"], ",").alias("roles"), F.md5(F.array_join(parts, "|")).alias("digest"))


@query(f"""
with t as (
  select conv_id, turn, role, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) as w,
         row_number() over (partition by conv_id order by turn, role, text) as k from conversations
), u as (select * from t where role in ('user', 'assistant')), r as (
  select conv_id, list(struct_pack(role := role, w := w) order by k) as turns, sum(w + 5) as body from u group by conv_id
), all_ids as (select distinct conv_id from conversations)
select a.conv_id, {MAX_LEN} as length, cast(least({MAX_LEN}, 10 + coalesce(r.body, 0)) as int) as tokens from all_ids a left join r using (conv_id)
""")
def chatml_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the masked training rows."""
    rows = _chat(spark, sf_dir)
    return rows.select("conv_id", F.size("input").alias("length"), F.size(F.filter("mask", lambda m: m)).alias("tokens"))


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = corpus.conversation(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return corpus.chat_rows(talks, "conv_id", MAX_LEN)


@query()
def chatml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows themselves."""
    return _chat(spark, sf_dir)


#: The public byte-level vocabulary of the queries on token ids.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


@query("select doc_id, octet_length(encode(text)) as n_bytes, md5(text) as text_md5 from documents")
def vocabulary_round_trip(spark: SparkSession, sf_dir: str, vocabulary: str = BYTE_LEVEL) -> DataFrame:
    """Whole documents in token ids and back: the bytes of their ids, and the text that these make."""
    known = bpe.read(vocabulary)
    small_batches(spark)
    rows = spread(_docs(spark, sf_dir)).select("doc_id", known.ids(F.col("text")).alias("ids"))
    text = known.text_of(F.col("ids"))
    return rows.select("doc_id", text.alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""
with t as (select conv_id, string_agg(case when role in ('user', 'assistant') then role || chr(10) || coalesce(text, '') || chr(10) end, '' order by turn, role, text) as said,
  string_agg(case when role = 'assistant' then coalesce(text, '') || chr(10) when role = 'user' then chr(10) end, '' order by turn, role, text) as learned from conversations group by conv_id)
select conv_id, 'system' || chr(10) || 'You are a helpful assistant.' || chr(10) || coalesce(said, '') as said, chr(10) || coalesce(learned, '') as learned from t
""")
def chatml_vocabulary(spark: SparkSession, sf_dir: str, vocabulary: str = BYTE_LEVEL) -> DataFrame:
    """Training rows in ids of a vocabulary, neither cut nor filled up, read back: all that is said, and what is learned from."""
    known = bpe.read(vocabulary)
    small_batches(spark)
    rows = corpus.chat_token_ids(spread(table(spark, sf_dir, "conversations")), "conv_id", "turn", "role", "text", None, known)
    return rows.select("conv_id", known.text_of(F.col("input_ids")).alias("said"), known.text_of(F.col("labels")).alias("learned"))


@query("""
select role, count(*) as turns, cast(sum(length(text)) as bigint) as chars, round(sum(length(text)) / 1000.0 * case role when 'assistant' then 0.06 else 0.03 end, 6) as cost
from conversations group by role
""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.when(F.col("role") == "assistant", 0.06).otherwise(0.03)
    sums = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return sums.withColumn("cost", F.round(F.col("chars") / 1000.0 * rate, 6))


@query("""
with n as (select distinct upper(regexp_extract(text, '^[^ ]+')) as name from benchmark where regexp_extract(text, '^[^ ]+') <> '')
select d.doc_id, n.name from documents d join n on contains(upper(d.text), n.name)
""")
def app_api_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries that a text mentions. A small catalogue goes to all texts as one list, a larger one meets their words by parts of words."""
    bench = table(spark, sf_dir, "benchmark")
    names = bench.select(simple_upper(F.regexp_extract("text", "^[^ ]+", 0)).alias("name")).filter("name <> ''").distinct()
    known = [r.name for r in names.limit(10_001).collect()]
    rows, upper = spread(_docs(spark, sf_dir)), simple_upper(F.col("text"))
    if len(known) > 10_000:
        return corpus.mentions(rows.select("doc_id", upper.alias("t")), "doc_id", "t", names, "name")
    hits = let(upper, lambda t: F.filter(F.array(*map(F.lit, known)), lambda n: t.contains(n))) if known else F.array().cast("array<string>")
    return rows.select("doc_id", F.explode(hits).alias("name"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def double_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties encoded as JSON twice, and decoded again."""
    once = F.from_json("props", "map<string,bigint>")
    e = table(spark, sf_dir, "events").select("event_id", encoded_twice(once).alias("raw"))
    return e.select("event_id", decoded_twice(F.col("raw"), "map<string,bigint>")["k"].alias("k"))


@query("""
with p as (select p_partkey, p_name, cast(('0x' || substr(md5('ask|' || p_partkey), 1, 8)) as bigint) % 5 as "at" from part)
select p_partkey, replace(case "at" when 0 then 'Where is {text}?' when 1 then 'Point to {text}.' when 2 then 'Find the box of {text}.'
  when 3 then 'Which element says {text}?' else 'Locate {text} on this page.' end, '{text}', p_name) as question from p
""")
def instruction_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", corpus.filled(corpus.picked(POOL, "ask", "p_partkey"), F.col("p_name")).alias("question"))


@query("""
with u as (select doc_id, source, text from documents union all select 1000000 + item_id, 'bench', text from benchmark)
select source, count(*) as docs, cast(sum(length(text)) as bigint) as chars from u group by source
""")
def two_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two input roots read as one."""
    bench = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000).alias("doc_id"), F.lit("bench").alias("source"), "text")
    both = _docs(spark, sf_dir).select("doc_id", "source", "text").unionByName(bench)
    return both.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("""
select l_shipdate, l_orderkey, l_linenumber, round(avg(l_quantity) over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber rows between unbounded preceding and current row), 6) as running
from lineitem
""")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    means = corpus.running_mean(items, "l_quantity", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_suppkey")
    return means.select("l_shipdate", "l_orderkey", "l_linenumber", F.round("running", 6).alias("running"))


@query("select l_orderkey, l_returnflag, l_linenumber from lineitem qualify count(*) over (partition by l_orderkey, l_returnflag) = 1")
def unique_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.sources.files import alone_in_group

    return alone_in_group(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber"), "l_orderkey", "l_returnflag")
