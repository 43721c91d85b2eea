"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import alignment, exact_dedup, langid, minhash, mixing, ngram_join, prefix_trie, quality, secret_scan, sentence_pieces, suffix_dedup, token_count, topk
from corpusloom.llm.common import read, spread

Query = Callable[[SparkSession, str], DataFrame]


#: The public sentencepiece file whose pieces operators 2, 3 and 10 use.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: The public byte-level vocabulary that operator 12 aligns with them.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(read(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str, words: str = PIECES) -> DataFrame:
    language = secret_scan.Language(secret_scan.read_words(words))
    return secret_scan.scan(spread(read(spark, sf_dir, "documents")), language, secret_scan.train(language))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    return sentence_pieces.encode(spread(read(spark, sf_dir, "documents")), model)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(spread(read(spark, sf_dir, "documents")), words=2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(spread(read(spark, sf_dir, "documents")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(spread(read(spark, sf_dir, "documents")))


def op10_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = PIECES) -> DataFrame:
    return token_count.report(spread(read(spark, sf_dir, "documents")), token_count.read_vocabulary(vocabulary), *token_count.read_fallbacks(vocabulary))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(spread(read(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str, first: str = BYTE_LEVEL, second: str = PIECES) -> DataFrame:
    return alignment.report(spread(read(spark, sf_dir, "documents")), first, second)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_ngram_join": op11_ngram_join,
    "op12_token_alignment": op12_token_alignment,
    "op13_prefix_trie": op13_prefix_trie,
}

_OP1_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), g as (
  select *, count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over (partition by text_sha256 order by n_cp desc, doc_id) as keep_id
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""

_OP8_SQL = r"""
with recursive d as (
  select doc_id, source,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) as h
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size from d group by source
), w as (
  select source, source_size, 2.0::double * source_size as cap,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0 else 1.0 end as w
  from s
), r(step, source, source_size, cap, w, fixed, left_over) as (
  select 0, source, source_size, cap, w, false, 1.5::double * (select sum(source_size) from s) from w
  union all
  select step + 1, source, source_size, cap, w, fixed or hit,
         left_over - coalesce(sum(case when hit then cap end) over (), 0)
  from (
    select *, not fixed and cap < left_over * w / sum(case when not fixed then w end) over () as hit from r
  ) t
  qualify bool_or(hit) over ()
), last as (
  select * from r qualify step = max(step) over ()
), t as (
  select source, source_size, case when fixed then cap else left_over * w / sum(case when not fixed then w end) over () end as target
  from last
), b as (
  select source, source_size, target,
         case when source_size > 0 then floor(target / source_size) else 0 end as passes
  from t
), run as (
  select d.doc_id, d.size, b.source_size, b.target, b.passes, b.target - b.passes * b.source_size as rest,
         sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as upto,
         sum(d.size) over (partition by d.source, d.h) as mass
  from d join b on d.source is not distinct from b.source
)
select doc_id, size, source_size, target,
       cast(size * (passes + case when rest > 0 and (upto <= rest or (upto - mass <= rest and upto - rest <= rest - (upto - mass))) then 1 else 0 end) as bigint) as taken
from run
"""

_OP6_SQL = r"""
with recursive w as (
  select rowid as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from (select row_number() over () as rowid, * from documents)
), s as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
    else list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) end as s from w
), class as (
  select md5(array_to_string(list_sort(s), chr(10))) as c, min(doc_id) as rep, len(any_value(s)) as n, any_value(s) as s from s where len(s) > 0 group by c
), t as (select c, n, unnest(s) as t from class),
f as (select t, count(*) as df from t group by t having count(*) > 1),
p as (select c, n, t, row_number() over (partition by c order by coalesce(df, 1), t) as k, df from t left join f using (t)),
rare as (select c, n, t from p where df is not null and k <= n - ceil(0.8 * n) + 1),
pair as (select distinct a.c as a, b.c as b from rare a join rare b on a.t = b.t and a.c < b.c and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
edge as (
  select a, b from pair join class x on x.c = a join class y on y.c = b
  where 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), both_ways as (select a, b from edge union all select b, a from edge),
reach(c, via) as (select c, c from class union select reach.c, e.b from reach join both_ways e on e.a = reach.via),
least_of as (select reach.c, min(k.rep) as component_id from reach join class k on k.c = reach.via group by reach.c)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(l.component_id, s.doc_id) as component_id, s.doc_id = coalesce(l.component_id, s.doc_id) as kept
from s left join least_of l on len(s.s) > 0 and l.c = md5(array_to_string(list_sort(s.s), chr(10)))
"""

_OP11_SQL = r"""
with recursive w as (
  select rowid as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from (select row_number() over () as rowid, * from documents)
), s as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w
), class as (
  select md5(array_to_string(list_sort(s), chr(10))) as c, min(doc_id) as rep, len(any_value(s)) as n, any_value(s) as s from s where len(s) > 0 group by c
), t as (select c, n, unnest(s) as t from class),
f as (select t, count(*) as df from t group by t having count(*) > 1),
p as (select c, n, t, row_number() over (partition by c order by coalesce(df, 1), t) as k, df from t left join f using (t)),
rare as (select c, n, t from p where df is not null and k <= n - ceil(0.8 * n) + 1),
pair as (select distinct a.c as a, b.c as b from rare a join rare b on a.t = b.t and a.c < b.c and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
edge as (
  select a, b from pair join class x on x.c = a join class y on y.c = b
  where 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), both_ways as (select a, b from edge union all select b, a from edge),
reach(c, via) as (select c, c from class union select reach.c, e.b from reach join both_ways e on e.a = reach.via),
least_of as (select reach.c, min(k.rep) as component_id from reach join class k on k.c = reach.via group by reach.c)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(l.component_id, s.doc_id) as component_id
from s left join least_of l on len(s.s) > 0 and l.c = md5(array_to_string(list_sort(s.s), chr(10)))
"""

_OP9_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
), block as (
  select r, n, b, substr(h, 800 * b + 1, 1600) as h from (select r, n, h, unnest(generate_series(0, n // 400)) as b from d where n >= 400)
), pos as (
  select r, 400 * b + o as p, md5(substr(h, 2 * o + 1, 800)) as m from (select r, n, b, h, unnest(generate_series(0, 399)) as o from block) where 400 * b + o + 400 <= n
), twice as (select m from pos group by m having count(*) > 1),
hit as (select r, p, lag(p) over w as before, lead(p) over w as next from pos semi join twice using (m) window w as (partition by r order by p)),
cut as (
  select r, p as a, coalesce(before + 400 < p, true) as first, sum(case when coalesce(before + 400 < p, true) then 1 else 0 end) over (partition by r order by p) as k from hit
), span as (select r, k, min(a) as a, max(a) + 400 as b from cut group by r, k),
gap as (
  select r, coalesce(lag(b) over (partition by r order by a), 0) as a, a as b from span
  union all select r, max(b), (select n from d where d.r = span.r) from span group by r
), kept as (select g.r, string_agg(substr(d.h, 2 * g.a + 1, 2 * (g.b - g.a)), '' order by g.a) as h from gap g join d using (r) group by g.r),
total as (select r, sum(b - a) as n_removed, count(*) as n_spans from span group by r)
select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(t.n_removed, 0) as bigint) as n_removed, cast(coalesce(t.n_spans, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(k.h, d.h))) as kept_sha256
from d left join total t using (r) left join kept k using (r)
"""

_OP5_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, e.vec_id, cast(list_inner_product(q.v, e.v) as bigint) as score
  from e q join e on q.vec_id <> e.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 5
"""

_OP13_SQL = r"""
with recursive o as (
  select cast(conv_id as bigint) as c, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null
), steps as (  -- crc32, bit by bit: a byte is xored in, then eight shifts follow
  select c, max(k) as n, flatten(list_transform(list_transform(string_split(cast(c as varchar), ''), lambda x: ord(x)), lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1])) as s
  from o group by c
), plan as (
  select c, n, c - c % 20 as base,
         xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(s, lambda x: x::bigint)), lambda a, x:
           case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end)) % 4 as h
  from steps
), led as (
  select p.c, p.h, p.base, least(p.h, coalesce(b.n, 0)) as lead, least(p.h, coalesce(b.n, 0)) + greatest(p.n - p.h, 0) as n
  from plan p left join plan b on b.c = p.base
), t as (
  select o.c, o.k - l.h + l.lead as d, role, text from o join led l using (c) where o.k > l.h
  union all select l.c, o.k, role, text from led l join o on o.c = l.base and o.k <= l.lead
), walk(c, d, path) as (
  select c, 0::bigint, '' from led
  union all
  select w.c, t.d, sha256(w.path || '|' || length(role) || ':' || role || text) from walk w join t on t.c = w.c and t.d = w.d + 1
), node as (
  select d, path, min(c) as id, count(*) as n_convs from walk group by d, path
), member as (
  select w.c, w.d, n.id, n.n_convs, l.n from walk w join node n using (d, path) join led l on l.c = w.c
), own as (
  select m.d, m.id, any_value(m.n_convs) as n_convs,
         any_value((m.n_convs - 1) * coalesce(len(regexp_extract_all(t.text, '[^\x20\x09-\x0D]+')), 0)) as saved,
         sha256(coalesce(string_agg(cast(case when m.d = m.n then m.c end as varchar), ',' order by m.c), '')) as ends_sha256,
         max(m.n) = m.d as leaf
  from member m left join t on t.c = m.c and t.d = m.d group by m.d, m.id
), under as (
  select distinct a.d, a.id, b.d as bd, b.id as bid from member a join member b on a.c = b.c and b.d >= a.d
), rolled as (
  select u.d, u.id, count(*) filter (o.leaf) as n_leaves, sum(o.saved) as saved_tokens, count(*) filter (u.bd = u.d + 1) as n_children
  from under u join own o on o.d = u.bd and o.id = u.bid group by u.d, u.id
), parent as (
  select distinct a.d, a.id, b.id as parent_conv_id from member a join member b on a.c = b.c and b.d = a.d - 1
)
select o.id as conv_id, o.d as depth, p.parent_conv_id, o.n_convs, r.n_children, r.n_leaves, cast(r.saved_tokens as bigint) as saved_tokens, o.ends_sha256
from own o join rolled r using (d, id) left join parent p using (d, id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": _OP1_SQL,
    "op5_exact_top_k": _OP5_SQL,
    "op6_minhash_near_dedup": _OP6_SQL,
    "op8_source_mixing": _OP8_SQL,
    "op9_suffix_array_dedup": _OP9_SQL,
    "op11_ngram_join": _OP11_SQL,
    "op13_prefix_trie": _OP13_SQL,
}
