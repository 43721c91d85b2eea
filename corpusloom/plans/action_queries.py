"""Rendered lines as actions, both ways, and what is asked about them; node tables; training ids; file layouts.

Lines are made of parts: ten parts are a page, and a part's key says whether its line is a text, an input, a scrollable or an image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import geometry, metrics
from corpusloom.functions.text import translated
from corpusloom.operators import corpus, elements, graph, uitree
from corpusloom.plans.catalog import query, table
from corpusloom.sources import files
from corpusloom.storage import scratch

_LINES = """
l0 as (select p_partkey as k, p_partkey // 10 as page, p_partkey % 10 as pos, p_partkey % 4 as kind, case when p_partkey % 8 = 0 then '中文' else p_name end as name,
              p_partkey % 300 as x, p_size as y from part),
l1 as (select *, '[' || x || ',' || y || '][' || (x + 40) || ',' || (y + 8) || ']' as box, x + 20 as mx, y + 4 as my,
  case kind when 0 then '<p class="c" clickable="true"' when 1 then '<input class="c" clickable="false"' when 2 then '<div class="c" scrollable="true"' else '<img class="c" description="' || name || '" clickable="true"' end as head,
  case kind when 0 then '>  ' || name || '  </p>' when 1 then '>  ' || name || '  </input>' when 2 then '>   </div>' else '>   </img>' end as tail from l0),
lines as (select *, head || tail as line, head || ' bounds="' || box || '"' || tail as bounded from l1)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, made in an exchange of their own so that what is asked of them does not repeat how they are made."""
    k, lit = F.col("k"), F.lit
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 10).alias("page"), (F.col("p_partkey") % 10).alias("pos"), (F.col("p_partkey") % 4).alias("kind"),
        F.when(F.col("p_partkey") % 8 == 0, "中文").otherwise(F.col("p_name")).alias("name"), (F.col("p_partkey") % 300).cast("int").alias("x"), F.col("p_size").cast("int").alias("y"),
    )
    x, y, name, kind = F.col("x"), F.col("y"), F.col("name"), F.col("kind")
    area = geometry.box(x, y, x + 40, y + 8)
    image = F.concat(lit('<img class="c" description="'), name, lit('" clickable="true"'))
    head = F.when(kind == 0, '<p class="c" clickable="true"').when(kind == 1, '<input class="c" clickable="false"').when(kind == 2, '<div class="c" scrollable="true"').otherwise(image)
    tail = F.when(kind == 0, F.concat(lit(">  "), name, lit("  </p>"))).when(kind == 1, F.concat(lit(">  "), name, lit("  </input>"))).when(kind == 2, ">   </div>").otherwise(">   </img>")
    made = rows.select("*", area.alias("area"), geometry.bounds_text(area).alias("box"), head.alias("head"), tail.alias("tail"))
    lines = made.select(k, "page", "pos", "kind", "name", "area", "box", F.concat("head", "tail").alias("line"), F.concat("head", lit(' bounds="'), "box", lit('"'), "tail").alias("bounded"))
    return lines.repartition("page")


@query(f"""
with {_LINES} select k, case kind when 1 then 'input(<ref>' || name || '</ref><box>' || box || '</box>)' when 2 then
  'scroll(<box>' || box || '</box>,up)|scroll(<box>' || box || '</box>,down)|scroll(<box>' || box || '</box>,left)|scroll(<box>' || box || '</box>,right)'
  else 'click(<ref>' || name || '</ref><box>' || box || '</box>)' end as actions from lines
""")
def action_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("k", F.array_join(elements.action_space(F.col("line"), F.col("box")), "|").alias("actions"))


@query(f"""
with {_LINES} select k, case k % 6 when 0 then 'click(' || bounded || ')' when 1 then 'scroll(([' || mx || ', ' || (my + 2) || '], [' || mx || ', ' || (my - 2) || ']))'
  when 2 then 'scroll(([' || (x + 30) || ', ' || my || '], [10, ' || my || ']))' when 3 then 'input(' || bounded || ', ''hi'')' when 4 then 'press()' else '(' || bounded || ')' end as command from lines
""")
def device_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 6
    said = F.when(k == 0, "click(1)").when(k == 1, "scroll(1,up)").when(k == 2, "scroll(1,left,long)").when(k == 3, "Input(1,hi)").when(k == 4, "press(2)").otherwise("swipe(1)")
    return _lines(spark, sf_dir).select("k", elements.command(said, F.create_map(F.lit(1), F.col("bounded")), 720, 1280).alias("command"))


_MODEL = """
case kind when 2 then case when k % 8 = 2 then 'scroll(<box>' || box || '</box>,up)' else 'scroll(' || box || ',left)' end
  when 1 then 'input(<ref>' || name || '</ref>, hi)' else 'click(<ref>' || name || '</ref>)' end
"""


@query(f"""
with {_LINES} select k, case kind when 2 then case when k % 8 = 2 then 'scroll([' || mx || ', ' || (my + 2) || '], [' || mx || ', ' || (my - 2) || '])'
    else 'scroll([' || (mx + 10) || ', ' || my || '], [' || (mx - 10) || ', ' || my || '])' end
  when 1 then case when k % 3 = 0 then 'input()' else 'input(' || line || ',hi)' end when 3 then null else 'click(' || line || ')' end as raw from lines
""")
def raw_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model actions as raw commands; images' clicks and some inputs are not in the map."""
    k, kind, name, box = F.col("k"), F.col("kind"), F.col("name"), F.col("box")
    ref = F.concat(F.lit("<ref>"), name, F.lit("</ref>"))
    scroll = F.when(k % 8 == 2, F.concat(F.lit("scroll(<box>"), box, F.lit("</box>,up)"))).otherwise(F.concat(F.lit("scroll("), box, F.lit(",left)")))
    said = F.when(kind == 2, scroll).when(kind == 1, F.concat(F.lit("input("), ref, F.lit(", hi)"))).otherwise(F.concat(F.lit("click("), ref, F.lit(")")))
    known = F.create_map(
        F.when(kind == 0, F.concat(F.lit("click("), ref, F.lit(")"))).otherwise("none"), F.concat(F.lit("click("), F.col("line"), F.lit(")")),
        F.when((kind == 1) & (k % 3 != 0), ref).otherwise("nothing"), F.col("line"),
    )
    return _lines(spark, sf_dir).select("k", elements.raw_command(said, known).alias("raw"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c]), "\n").alias(c)
    pages = _lines(spark, sf_dir).groupBy("page").agg(text("line"), text("bounded"))
    return elements.element_labels(elements.zipped_lines(pages, "page", "line", "bounded"), "page")


_LABELS = "labels as (select page, line, nullif(arg_min(case kind when 2 then '' else name end, pos), '') as label, arg_min(box, pos) as box from lines group by page, line)"


@query(f"with {_LINES}, {_LABELS} select page, line, label, box from labels")
def element_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@query(f"""
with {_LINES}, {_LABELS} select k, case kind when 2 then 'scroll(<box>' || l.box || '</box>,up)' when 1 then 'input(<ref>' || d.label || '</ref><box>' || d.box || '</box>, hi)'
  else 'click(<ref>' || d.label || '</ref><box>' || d.box || '</box>)' end as model from lines l join labels d using (page, line)
""")
def model_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw commands as model actions; scrolls by their end points."""
    kind, line = F.col("kind"), F.col("line")
    rows = _lines(spark, sf_dir)
    scroll = F.concat(F.lit("scroll("), elements.scroll_ends(F.col("area"), F.lit("up")), F.lit(")"))
    said = F.when(kind == 2, scroll).when(kind == 1, F.concat(F.lit("input("), line, F.lit(", 'hi')"))).otherwise(F.concat(F.lit("click("), line, F.lit(")")))
    items = rows.filter("kind = 2").select("page", F.explode(elements.action_space(line, F.col("box"))).alias("item"))
    return elements.to_model_action(rows.select("k", "page", said.alias("action")), _labels(spark, sf_dir), "page", scrolls=items).select("k", "model")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, line = F.col("kind"), F.col("line")
    said = F.when(kind == 1, F.concat(F.lit("input("), line, F.lit(", hi)"))).when(kind == 2, F.concat(F.lit("scroll("), line, F.lit(",up)"))).otherwise(F.concat(F.lit("click("), line, F.lit(")")))
    return _lines(spark, sf_dir).select("k", "page", elements.key_of(said).alias("v")).select("k", "page", "v.key", "v.action_type")


@query(f"with {_LINES} select k, case when kind <> 2 then name end as key, case kind when 2 then null when 1 then 'hi' else 'click' end as action_type from lines")
def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir).select("k", "key", "action_type")


@query(f"""
with {_LINES}, s as (select page, name as key, case kind when 1 then 'hi' else 'click' end as action_type from lines where kind <> 2),
r as (select *, case when action_type <> 'click' then 0 when regexp_matches(key, '^[一-龥]*$') then 1 end as rank from s)
select page, key, action_type from r where rank is not null
qualify row_number() over (partition by page order by rank, md5('s|' || page || '|' || key || '|' || action_type)) = 1
""")
def sampled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.sampled_key(_keys(spark, sf_dir).filter("key is not null").select("page", "key", "action_type"), "page", "s")


_PAGE = """
pages_of as (select page, coalesce(list(name order by pos) filter (kind = 1), []) as i, coalesce(list(name order by pos) filter (kind in (0, 3)), []) as c,
                    coalesce(list(box order by pos) filter (kind = 2), []) as s from lines group by page)
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda ok, c: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("pos", c)))), lambda s: s[c])
    kind = F.col("kind")
    return _lines(spark, sf_dir).groupBy("page").agg(some(kind == 1, "name").alias("i"), some(kind.isin(0, 3), "name").alias("c"), some(kind == 2, "box").alias("s"))


@query(f"""
with {_LINES}, {_PAGE} select page, case when len(i) > 0 then 'Inputs: ' || array_to_string(i, ', ') || '.' else 'No inputs.' end || ' ' ||
  case when len(c) > 0 then 'Clickable: ' || array_to_string(c, ', ') || '.' else 'Nothing to click.' end as summary from pages_of
""")
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page", elements.summary(F.col("i"), F.col("c")).alias("summary"))


@query(f"""
with {_LINES}, {_PAGE} select page, case when len(c) > 0 or len(i) > 0 then 'clickable:' || chr(10) || array_to_string(c, chr(10)) || chr(10) || 'inputs:' || chr(10) || array_to_string(i, chr(10)) || chr(10) ||
  'scrollable:' || chr(10) || array_to_string(s, chr(10)) end as text from pages_of
""")
def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page", elements.sections(F.col("c"), F.col("i"), F.col("s")).alias("text"))


@query(f"""
with {_LINES}, p as (select p_partkey // 10 as page, p_partkey % 3 = 0 as said, p_partkey % 2 = 0 as wanted, case when p_partkey % 5 = 0 then ' whole ' || p_size || ', line ' else '<ref>t' || p_size || '</ref><box>[1,2]</box>' end as line from part),
t as (select page, said, wanted, case when starts_with(line, '<ref>') then regexp_extract(line, '<ref>([^,]+)</ref>', 1) else trim(line) end as t from p),
g as (select page, coalesce(list(distinct t) filter (said), []) as a, coalesce(list(distinct t) filter (wanted), []) as b from t group by page)
select page, round(case when len(b) > 0 then len(list_intersect(a, b)) / len(b) else 0 end, 6) as recall from g
""")
def ref_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over the lines' reference texts, whole lines where they have none."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    line = F.when(k % 5 == 0, F.concat(F.lit(" whole "), size, F.lit(", line "))).otherwise(F.concat(F.lit("<ref>t"), size, F.lit("</ref><box>[1,2]</box>")))
    rows = table(spark, sf_dir, "part").select(F.floor(k / 10).alias("page"), (k % 3 == 0).alias("said"), (k % 2 == 0).alias("wanted"), metrics.line_text(line).alias("t"))
    g = rows.groupBy("page").agg(F.collect_set(F.when(F.col("said"), F.col("t"))).alias("a"), F.collect_set(F.when(F.col("wanted"), F.col("t"))).alias("b"))
    return g.select("page", F.round(metrics.recall(F.col("a"), F.col("b")), 6).alias("recall"))


@query(f"""
with {_LINES} select k, case when k % 3 < 2 then x else -1 end as x1, case when k % 3 < 2 then y else -1 end as y1, case when k % 3 < 2 then x + 40 else -1 end as x2, case when k % 3 < 2 then y + 8 else -1 end as y2 from lines
""")
def dual_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in either of two notations, -1 where a text has neither; corner forms agree."""
    a = F.col("area")
    round_ = F.format_string("(%d,%d),(%d, %d)", a.x1, a.y1, a.x2, a.y2)
    said = F.when(F.col("k") % 3 == 0, F.col("box")).when(F.col("k") % 3 == 1, round_).otherwise("no box")
    rows = _lines(spark, sf_dir).select("k", geometry.any_box(said).alias("b"))
    b = F.col("b")
    return rows.select("k", geometry.corners(b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1).alias("c")).select("k", "c.*").na.fill(-1)


@query("select lang, case lang when 'en' then 'English' when 'de' then 'German' else lang end as name, count(*) as docs from documents group by lang")
def translated_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"))
    return counts.select("lang", translated(F.col("lang"), {"en": "English", "de": "German"}).alias("name"), "docs")


@query("select event_id, 'adb -s 10.0.0.2:5555 shell ' || event_type as command from events")
def readdressed_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat(F.lit("adb -s 10.0.0.1:5555 shell "), "event_type")
    return table(spark, sf_dir, "events").select("event_id", elements.readdressed(c, "10.0.0.1:", "10.0.0.2:").alias("command"))


@query("select page_id, not contains(html, regexp_extract(url, '^https?://([^/]+)', 1)) as leaves from pages")
def pages_leaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that do not mention what they belong to."""
    return table(spark, sf_dir, "pages").select("page_id", (~F.contains("html", F.regexp_extract("url", "^https?://([^/]+)", 1))).alias("leaves"))


@query("""
with a as (select doc_id, case when doc_id % 5 = 0 then 'html error' when doc_id % 5 = 1 then null when doc_id % 7 = 0 then 'xml error' else substr(text, 1, 40) end as html from documents)
select doc_id, html from a where html is not null and html not in ('html error', 'xml error') and not contains(html, 'img>')
""")
def without_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    html = F.when(d % 5 == 0, "html error").when(d % 5 == 1, F.lit(None)).when(d % 7 == 0, "xml error").otherwise(F.substring("text", 1, 40))
    rows = table(spark, sf_dir, "documents").select("doc_id", corpus.known(html).alias("html"))
    return rows.filter(F.col("html").isNotNull() & ~F.col("html").contains("img>"))


@query("select 'pkg' || p_size as package, arg_min(p_name, p_partkey) as name, min(p_partkey) as ord from part group by p_size")
def catalogue_by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("pkg"), F.col("p_size").cast("string")).alias("package"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return files.first_by(rows, "package", "ord")


@query("select p_partkey, p_name from part where p_brand = (select min(p_brand) from part)")
def catalogue_of_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return files.of_mode(rows, rows.agg(F.min("p_brand")).first()[0], "p_brand").select("p_partkey", "p_name")


@query("""
with f as (select event_type, min(event_id) as s from events group by event_type), i as (select event_type, row_number() over (order by s, event_type) - 1 as id from f)
select e.event_id, e.event_id % 7 as id, i.event_type as action from events e left join i on i.id = e.event_id % 7
""")
def action_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ids = graph.first_seen_ids(e, "event_type", "event_id").select("id", F.col("event_type").alias("action"))
    return graph.named_actions(e.select("event_id", (F.col("event_id") % 7).alias("id")), ids, "id", "action").select("event_id", "id", "action")


@query("select 'app' || max(user_id) || '-html' as name from events")
def last_index_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.concat(F.lit("app"), F.col("user_id").cast("string"), F.lit("-html")).alias("name"))
    return graph.last_name(names, r"^app(\d+)-html$")


@query("""
with n as (select distinct 'app' || user_id || '_' || event_type as name from events)
select name, row_number() over (order by split_part(name, '_', 2) || name) - 1 as place from n
""")
def suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.concat(F.lit("app"), F.col("user_id").cast("string"), F.lit("_"), "event_type").alias("name"))
    return graph.by_suffix(names)


def _pool_sql(task: str, keys: str) -> str:
    pool = corpus.POOLS[task]
    cases = " ".join(f"when {i} then '{t.replace(chr(39), 2 * chr(39))}'" for i, t in enumerate(pool))
    own = "chr(10) || " if task in corpus.OWN_LINE else ""
    return f"{own}case cast(('0x' || substr(md5('{task}|' || {keys}), 1, 8)) as bigint) % {len(pool)} {cases} end"


@query(" union all ".join(f"select p_partkey, '{t}' as task, {_pool_sql(t, 'p_partkey')} as instruction from part" for t in corpus.POOLS))
def task_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [F.struct(F.lit(t).alias("task"), corpus.task_instruction(t, t, "p_partkey").alias("instruction")) for t in corpus.POOLS]
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*each)).alias("t")).select("p_partkey", "t.*")


@query(f"""
with p as (select distinct 'app' || user_id || '0_' || string_agg(event_type, '_') over (partition by user_id order by event_id) as name from events),
k as (select name as child, regexp_extract(name, '^(.*)_[^_]*$', 1) as parent, array_to_string(string_split(name, '_')[:-2], '/') as folder, regexp_extract(name, '([^_]*)$', 1) as action from p)
select parent, child, folder, {_pool_sql("next", "child")} as instruction, action from k where parent in (select name from p)
""")
def pair_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on pages and the pages they were reached from, written as JSON and read back."""
    pages = graph.cumulative_paths(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")
    rows = corpus.pair_instructions(pages)
    files.write_json(rows, path := scratch(spark, "pairs"))
    return spark.read.schema(rows.schema).json(path)


@query(f"""
with {_LINES}, {_LABELS}, one as (select page, label, box from labels where label is not null qualify row_number() over (partition by page order by md5('locate|' || page || '|' || line), line) = 1)
select page, replace({_pool_sql("locate", "page")}, '{{text}}', label) as question, '<ref>' || label || '</ref><box>' || box || '</box>' as answer from one
""")
def grounding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.grounding_pairs(_labels(spark, sf_dir), "page", "locate")


_NODES = """
i as (select l_orderkey as page, l_linenumber - 1 as a, max(cast(l_quantity as int) % 4) as kids from lineitem group by all),
nodes as (
  select distinct page, '' as place, null::bigint as a, null::bigint as b from i union all select page, '/' || a, a, null from i
  union all select page, '/' || a || '/' || b, a, b from (select page, a, unnest(range(0, kids)) as b from i)
)
"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of node tables: an order is the root, its lines are children, with up to three children each."""
    at = [F.col("l_orderkey").alias("page"), (F.col("l_linenumber") - 1).cast("int").alias("a")]
    i = table(spark, sf_dir, "lineitem").groupBy(*at).agg(F.max(F.col("l_quantity").cast("int") % 4).alias("kids"))
    root = i.select("page").distinct().select("page", F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(1).alias("depth"), F.lit("").alias("place"), F.lit(False).alias("is_leaf"))
    a = F.col("a")
    own = (a * 10 + 1).cast("int")
    child = i.select("page", own.alias("node_id"), F.lit(0).alias("parent_id"), F.lit(2).alias("depth"), F.concat(F.lit("/"), a.cast("string")).alias("place"), (F.col("kids") == 0).alias("is_leaf"))
    below = i.filter("kids > 0").select("page", "a", F.explode(F.sequence(F.lit(0), F.col("kids") - 1)).alias("b"))
    grand = below.select("page", (own + 1 + F.col("b")).alias("node_id"), own.alias("parent_id"), F.lit(3).alias("depth"), F.concat_ws("/", F.lit(""), a.cast("string"), F.col("b").cast("string")).alias("place"), F.lit(True).alias("is_leaf"))
    return root.unionByName(child).unionByName(grand)


@query(f"""
with {_NODES} select page, cast(1 + count(*) + sum(kids) as bigint) as n_nodes, cast(sum(greatest(kids, 1)) as bigint) as n_leaves, cast(max(case when kids > 0 then 3 else 2 end) as int) as max_depth from i group by page
""")
def node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uitree.tree_metrics(_nodes(spark, sf_dir), "page")


_NODE_PAIRS = "pairs as (select distinct l_orderkey - 1 as a, l_orderkey as b from lineitem)"


def _node_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select((k - 1).alias("a"), k.alias("b")).distinct()


@query(f"""
with {_NODES}, {_NODE_PAIRS}, n as (select page, count(*) as n from nodes group by page),
both_ as (select p.a, p.b, count(*) as m from pairs p join nodes x on x.page = p.a join nodes y on y.page = p.b and x.place = y.place group by all)
select p.a, p.b, cast(coalesce(x.n, 0) + coalesce(y.n, 0) - 2 * coalesce(m, 0) as bigint) as unmatched,
  round((coalesce(x.n, 0) + coalesce(y.n, 0) - 2 * coalesce(m, 0)) / ((coalesce(x.n, 0) + coalesce(y.n, 0)) / 2), 6) as difference
from pairs p left join n x on x.page = p.a left join n y on y.page = p.b left join both_ t on t.a = p.a and t.b = p.b
""")
def node_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's tree against that of the number before, which may have none."""
    d = uitree.tree_difference(_node_pairs(spark, sf_dir), _nodes(spark, sf_dir), "page")
    return d.withColumn("difference", F.round("difference", 6))


_DELTA = f"""
{_NODES}, {_NODE_PAIRS}, kids as (
  select page, '' as place, -1 as o, count(*) as kids from i group by page union all select page, '/' || a, a, kids from i
  union all select page, '/' || a || '/' || b, a, 0 from (select page, a, unnest(range(0, kids)) as b from i)),
met as (select p.a, p.b, x.o, sum(abs(x.kids - y.kids)) as d from pairs p join kids x on x.page = p.a join kids y on y.page = p.b and x.place = y.place group by all)
"""


@query(f"with {_DELTA} select p.a, p.b, cast(coalesce(sum(d), 0) as bigint) as delta from pairs p left join met m on m.a = p.a and m.b = p.b group by p.a, p.b")
def node_child_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uitree.child_count_delta(_node_pairs(spark, sf_dir), _nodes(spark, sf_dir), "page")


@query(f"""
with {_DELTA}, s as (select *, coalesce(sum(d) over (partition by a, b order by o rows between unbounded preceding and 1 preceding), 0) as before from met)
select p.a, p.b, cast(coalesce(sum(d) filter (before < 3), 0) as bigint) as delta from pairs p left join s on s.a = p.a and s.b = p.b group by p.a, p.b
""")
def node_child_delta_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, broken off where it has reached 3."""
    return uitree.child_count_delta(_node_pairs(spark, sf_dir), _nodes(spark, sf_dir), "page", stop=3)


#: Rows are filled up to this many ids; longer ones stay whole.
_CHAT = 96


@query(f"""
with t as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn, role, text) as k from conversations),
b as (select *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: cast('0x' || h as int)) as v, list_transform(regexp_extract_all(hex(encode(role)), '..'), lambda h: cast('0x' || h as int)) as r
      from t where role in ('user', 'assistant')),
p as (select conv_id, k, list_concat([256], r, [10], v, [257, 10]) as i,
        list_concat([256], list_transform(range(0, len(r) + 1 + case role when 'user' then len(v) else 0 end), lambda x: -100), case role when 'user' then [] else v end, [257, 10]) as l from b),
h as (select list_concat([256], list_transform(regexp_extract_all(hex(encode('system')), '..'), lambda h: cast('0x' || h as int)), [10],
        list_transform(regexp_extract_all(hex(encode('You are a helpful assistant.')), '..'), lambda h: cast('0x' || h as int))) as s),
a as (select c.conv_id, list_concat((select s from h), [257, 10], coalesce((select flatten(list(i order by k)) from p where p.conv_id = c.conv_id), [])) as i,
        list_concat([256], list_transform(range(1, (select len(s) from h)), lambda x: -100), [257, 10], coalesce((select flatten(list(l order by k)) from p where p.conv_id = c.conv_id), [])) as l
      from (select distinct conv_id from conversations) c)
select conv_id, array_to_string(list_concat(i, list_transform(range(0, greatest({_CHAT} - len(i), 0)), lambda x: 258)), ',') as input_ids,
       array_to_string(list_concat(l, list_transform(range(0, greatest({_CHAT} - len(l), 0)), lambda x: -100)), ',') as labels, cast(len(i) as int) as attended from a
""")
def chatml_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows in token ids, over all bytes of the texts."""
    talks = corpus.conversation(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    rows = corpus.chat_ids(talks, "conv_id", _CHAT, cut=False)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("conv_id", text("input_ids").alias("input_ids"), text("labels").alias("labels"), F.size(F.filter("attention_mask", lambda m: m)).alias("attended"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    files.write_json(rows, path := scratch(spark, "json"))
    return spark.read.schema(rows.schema).json(path)


@query("select cast(conv_id as varchar) as conv_id, cast(turn as varchar) as turn, role, text from conversations")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows.write.csv(path := scratch(spark, "csv"), header=True, escape='"', quoteAll=True)
    return files.read_csv(spark, path)


@query("select 'p' || p_partkey as key, p_name as value, (select count(*) from part) as rows from part")
def dictionary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value"))
    n = files.write_dictionary(rows, path := scratch(spark, "tsv"))
    return spark.read.schema("key string, value string").csv(path, sep="\t").withColumn("rows", F.lit(n).cast("long"))


@query("select 'k' || n_nationkey as key, n_name as value from nation")
def map_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    files.write_map(rows, path := scratch(spark, "map"))
    return files.read_map(spark, path)


@query(r"select regexp_replace(unnest(string_split(text, chr(10))), '^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$', '', 'g') as line from benchmark")
def line_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.write_lines(table(spark, sf_dir, "benchmark").select(F.col("text").alias("line")), path := scratch(spark, "lines"))
    return files.read_lines(spark, path)


@query("select event_id, event_type from events")
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of two appends, read back whole."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    path = scratch(spark, "log")
    for half in (0, 1):
        files.append_rows(rows.filter(F.col("event_id") % 2 == half), path)
    return spark.read.schema(rows.schema).json(path)


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp from events")
def usage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_usage_time(table(spark, sf_dir, "events")).select("event_id", "timestamp")


@query("select s_suppkey as annotation_id, n_name as category, 'n' || n_regionkey as file_name, s_nationkey % 10 as w from supplier join nation on n_nationkey = s_nationkey")
def coco_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation file's images, annotations and categories, joined again after reading."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    k = F.col("n_regionkey")
    images = nation.select(k).distinct().agg(F.collect_list(F.struct(k.alias("id"), F.concat(F.lit("n"), k.cast("string")).alias("file_name"), F.lit(9).alias("width"), F.lit(9).alias("height"))).alias("images"))
    names = nation.agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("categories"))
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    box = F.array(F.lit(0.0), F.lit(0.0), (F.col("s_nationkey") % 10).cast("double"), F.lit(1.0))
    notes = placed.agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), k.alias("image_id"), F.col("n_nationkey").alias("category_id"), box.alias("bbox"), F.lit(0).alias("iscrowd"))).alias("annotations"))
    images.crossJoin(notes).crossJoin(names).coalesce(1).write.json(path := scratch(spark, "coco"))  # one row: the file is one object
    return files.read_coco(spark, path).select("annotation_id", "category", "file_name", F.col("bbox")[2].cast("long").alias("w"))
