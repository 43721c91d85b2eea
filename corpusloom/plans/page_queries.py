"""Web pages as trees and as lists of interactive elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import elements, uitree
from corpusloom.plans.catalog import query, spread, table
from corpusloom.sources.files import data_url

TEXTS = ["hello", "42"]


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per tag with the text behind it; links and buttons are marked clickable, as a renderer would."""
    pages = table(spark, sf_dir, "pages")
    tags = F.regexp_extract_all("html", F.lit(r"(<[a-zA-Z][^<>]*>[^<]*)"), 1)
    mark = lambda t: F.when(t.rlike("^<(a|button)[ >]"), F.regexp_replace(t, "^<(a|button)", '<$1 class="link" clickable="true"')).otherwise(t)
    return pages.select("page_id", F.transform(tags, mark).alias("lines"))


_TAGS = r"""
t as (select page_id, unnest(regexp_extract_all(html, '(<[a-zA-Z][^<>]*>[^<]*)')) as tag, generate_subscripts(regexp_extract_all(html, '(<[a-zA-Z][^<>]*>[^<]*)'), 1) as pos from pages),
m as (select page_id, pos, case when regexp_matches(tag, '^<(a|button)[ >]') then regexp_replace(tag, '^<(a|button)', '<\1 class="link" clickable="true"') else tag end as line from t),
e as (select page_id, cast(row_number() over (partition by page_id order by pos) as int) as idx, regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') as line
      from m where contains(line, 'clickable="true"') or contains(line, 'scrollable="true"') or contains(line, 'input')),
c as (select *, case when contains(line, 'input') or contains(line, 'EditText') then 'Inputs' when contains(line, 'scrollable="true"') then 'Scrollables' when contains(line, 'clickable="true"') then 'Clickables' end as category,
      nullif(regexp_extract(line, '(?:^|\s)class="([^"]+)"', 1), '') as class,
      nullif(regexp_extract(line, '(?:^|\s)description="([^"]+)"', 1), '') as given from e)
"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.numbered(_tags(spark, sf_dir), "page_id", F.col("lines"))


@query(f"with {_TAGS} select page_id, idx, line, category from c")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _elements(spark, sf_dir)
    return e.select("page_id", "idx", "line", elements.category(F.col("line")).alias("category"))


@query(f"""
with {_TAGS}, k as (select page_id, idx, category, case category when 'Clickables' then 1 when 'Scrollables' then 2 else 3 end as rank from c where class is not null or given is not null),
a as (
  select page_id, rank, idx, 0 as k, 'click(' || idx || ')' as action from k where category <> 'Scrollables'
  union all select page_id, rank, idx, 1, 'input(' || idx || ',hello)' from k where category = 'Inputs'
  union all select page_id, rank, idx, 2, 'input(' || idx || ',42)' from k where category = 'Inputs'
)
select page_id, cast(row_number() over (partition by page_id order by rank, idx, k) as int) as ord, action from a
""")
def page_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.actions(elements.categorised(_elements(spark, sf_dir)), "page_id", TEXTS)


@query(f"""
with {_TAGS}, d as (select page_id, idx, regexp_extract(line, '>\\s*([^<>]+)$', 1) as text from c where category = 'Clickables')
select page_id, idx, nullif(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'), '') as key from d
""")
def link_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.functions.text import stripped

    e = _elements(spark, sf_dir).filter(elements.category(F.col("line")) == "Clickables")
    return e.select("page_id", "idx", F.nullif(stripped(F.regexp_extract("line", r">\s*([^<>]+)$", 1)), F.lit("")).alias("key"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uitree.parsed(spread(table(spark, sf_dir, "pages")), "page_id", "html", soup=True)


@query()
def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir)


@query()
def tree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uitree.tree_metrics(_nodes(spark, sf_dir), "page_id")


@query()
def tree_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uitree.pages_of(uitree.rendered_lines(_nodes(spark, sf_dir), "page_id"), "page_id")


@query()
def tree_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's tree against that of the page before it."""
    nodes = _nodes(spark, sf_dir)
    pairs = table(spark, sf_dir, "pages").filter("page_id > 0").select((F.col("page_id") - 1).alias("a"), F.col("page_id").alias("b"))
    return uitree.tree_difference(pairs, nodes, "page_id")


@query()
def child_count_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "pages").filter("page_id > 0").select((F.col("page_id") - 1).alias("a"), F.col("page_id").alias("b"))
    return uitree.child_count_delta(pairs, _nodes(spark, sf_dir), "page_id")


@query("select page_id, 'data:text/html;base64,' || to_base64(encode(html)) as url from pages")
def page_data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", data_url(F.encode("html", "UTF-8"), "text/html").alias("url"))


def _screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML page per order: a frame with an element for each of its items."""
    n, item = F.col("l_linenumber").cast("string"), F.col("l_linenumber") % 3
    kind = F.when(item == 0, "android.widget.TextView").when(item == 1, "android.widget.Button").otherwise("android.widget.ImageView")
    box = F.concat(F.lit("["), n, F.lit(",1]["), F.col("l_quantity").cast("int").cast("string"), F.lit(",2]"))
    element = F.concat(
        F.lit("<"), kind, F.lit(' text="'), "l_returnflag", F.lit(" "), n, F.lit('" resource-id="r'), n, F.lit('" package="p" class="c" bounds="'), box, F.lit('"/>')
    )
    inside = F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", element.alias("e"))))["e"], "")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(inside.alias("inside"))
    frame = F.concat(F.lit('<android.widget.FrameLayout clickable="'), (F.col("page_id") % 2 == 0).cast("string"), F.lit('" bounds="[0,0][9,9]">'))
    return rows.select("page_id", F.concat(F.lit("<hierarchy>"), frame, "inside", F.lit("</android.widget.FrameLayout></hierarchy>")).alias("xml"))


_SCREENS = """
i as (select l_orderkey as page_id, l_linenumber as n, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, trunc(l_quantity)::int || ',2]') as k, l_orderkey % 2 = 0 as lit,
  'android.widget.' || case l_linenumber % 3 when 0 then 'TextView' when 1 then 'Button' else 'ImageView' end as type,
  case l_linenumber % 3 when 0 then 'p' when 1 then 'button' else 'img' end as tag, l_returnflag || ' ' || l_linenumber as text,
  '[' || l_linenumber || ',1][' || trunc(l_quantity)::int || ',2]' as box from lineitem)
"""


def _screen_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uitree.parsed(_screens(spark, sf_dir), "page_id", "xml")


def _screen_pages(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return uitree.parsed_pages(_screens(spark, sf_dir), "page_id", "xml", columns)


@query(f"""
with {_SCREENS}, p as (select distinct page_id, lit from i)
select page_id, 0 as node_id, -1 as parent_id, 1 as depth, '' as place, 'hierarchy' as type, null as text, null as bounds, false as is_leaf, true as visible, false as inherited from p
union all select page_id, 1, 0, 2, '/0', 'android.widget.FrameLayout', null, '[0,0][9,9]', false, false, lit from p
union all select page_id, cast(k + 1 as int), 1, 3, '/0/' || (k - 1), type, text, box, true, true, lit from i
""")
def xml_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node tables of XML pages, with what nodes take over from those above; the root's parent is -1."""
    return _screen_nodes(spark, sf_dir).select("page_id", "node_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "depth", "place", "type", "text", "bounds", "is_leaf", "visible", "inherited")


def _screen_html(bounds: str) -> str:
    return f"""
with {_SCREENS}
select page_id, string_agg('<' || tag || ' id="r' || n || '" package="p" class="c"' || case when lit then ' clickable="true"' else '' end || {bounds} || '> ' || text || ' </' || tag || '>' || chr(10), '' order by k) as html
from i group by page_id
"""


@query(_screen_html("''"))
def xml_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uitree.rendered_pages(_screen_pages(spark, sf_dir, uitree.LINE_COLUMNS), "page_id")


@query(_screen_html("""' bounds="' || box || '"'"""))
def xml_html_with_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uitree.rendered_pages(_screen_pages(spark, sf_dir, uitree.LINE_COLUMNS), "page_id", with_bounds=True)


@query(f"with {_SCREENS} select page_id, string_agg('<ref>' || text || '</ref><box>' || box || '</box>', chr(10) order by k) as dump from i group by page_id")
def xml_text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uitree.page_text_boxes(_screen_pages(spark, sf_dir, ["text", "bounds", "place"]), "page_id")


@query(f"""
with {_SCREENS} select page_id, '(' || string_agg(case tag when 'img' then 'IMAGE' else upper(tag) end || ' - ' || text || ' ' || box, ', ' order by k) || ')' as dump from i group by page_id
""")
def xml_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uitree.nested_dumps(_screens(spark, sf_dir), "page_id", "xml")


@query("select p_partkey, cast(p_partkey as int) as width, cast(p_size + 256 * (p_partkey % 7) as int) as height from part")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of images from the heads of their files, PNG and GIF by turns."""
    from corpusloom.sources.files import image_size

    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("int").alias("w"), (F.col("p_size") + 256 * (F.col("p_partkey") % 7)).cast("int").alias("h"))
    four = lambda c: F.lpad(F.hex(c), 8, "0")
    two = lambda c: F.concat(F.lpad(F.hex(F.col(c) % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col(c) / 256).cast("long")), 2, "0"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four("w"), four("h"))
    gif = F.concat(F.lit("474946383961"), two("w"), two("h"))
    small = (F.col("p_partkey") % 2 == 0) & (F.col("w") < 65536) & (F.col("h") < 65536)
    return part.select("p_partkey", image_size(F.unhex(F.when(small, gif).otherwise(png))).alias("s")).select("p_partkey", "s.width", "s.height")
