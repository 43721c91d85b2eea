"""View-hierarchy pages as flat node tables, and what is made of them.

Parsing is the one step that needs Python: a table function over Arrow batches gives a row per node in pre-order,
with what a node inherits (a clickable ancestor) and its place (child indexes from the root). All
else is columns and aggregations over that table.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "node_id int, parent_id int, depth int, child_idx int, place string, type string, text string, content_desc string, "
    "resource_id string, package string, class_label string, clickable string, scrollable string, displayed string, bounds string, "
    "is_leaf boolean, visible boolean, inherited boolean"
)
_NAMES = [part.split()[0] for part in NODE_SCHEMA.split(", ")]
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
#: Nodes that a worker holds before it gives them out.
NODES_HELD = 4096
#: Elements that never have content in HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Fixed values, first match wins: what a type's name holds, and the tag it is rendered as.
TAGS = (
    ("ImageView", "img"), ("IconView", "img"), ("Button", "button"), ("Image", "img"),
    ("MenuItemView", "button"), ("EditText", "input"), ("TextView", "p"),
)


class _Soup(HTMLParser):
    """HTML with unclosed or stray tags, as nested dictionaries."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = {"type": "document", "kids": [], "text": ""}
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        node = {
            "type": tag, "kids": [], "text": "", "resource_id": a.get("id"), "class_label": a.get("class"),
            "content_desc": a.get("aria-label") or a.get("title") or a.get("alt"),
            "clickable": "true" if tag in ("a", "button", "input", "select") or "onclick" in a else None,
        }
        self.open[-1]["kids"].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i]["type"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if data.strip() and self.open[-1]["type"] not in ("script", "style"):
            node = self.open[-1]
            node["text"] = (node["text"] + " " + data.strip()).strip()


def _from_xml(source: str) -> ET.Element | None:
    if "<!DOCTYPE" in source or "<!ENTITY" in source:  # no entities from pages
        return None
    try:
        return ET.fromstring(source)
    except ET.ParseError:
        return None


def node_rows(source: str | None, soup: bool = False) -> list[tuple]:
    """Rows of NODE_SCHEMA in pre-order; none for a page that cannot be parsed."""
    if not source:
        return []
    if soup:
        parser = _Soup()
        parser.feed(source)
        parser.close()
        return _soup_rows(parser.root)
    root = _from_xml(source)
    return [] if root is None else _xml_rows(root)


def _seen(parent: int | None, text: str | None, description: str | None, type_: str) -> bool:
    return parent is None or bool(text) or bool(description) or "button" in (name := type_.lower()) or "edittext" in name


def _xml_rows(root: ET.Element) -> list[tuple]:
    rows: list[tuple] = []
    stack = [(root, None, 1, 0, "", False)]
    while stack:  # by a list of what is left, as pages may be nested deeper than calls
        e, parent, depth, idx, place, above = stack.pop()
        own, get, type_ = len(rows), e.get, e.tag
        text, description, clickable = get("text"), get("content-desc"), get("clickable")
        inherited = above or clickable == "true"
        rows.append((
            own, parent, depth, idx, place, type_, text, description, get("resource-id"), get("package"), get("class"), clickable,
            get("scrollable"), get("displayed"), get("bounds"), not len(e), _seen(parent, text, description, type_), inherited,
        ))
        for i in range(len(e) - 1, -1, -1):
            stack.append((e[i], own, depth + 1, i, f"{place}/{i}", inherited))
    return rows


def _soup_rows(root: dict) -> list[tuple]:
    rows: list[tuple] = []
    stack = [(root, None, 1, 0, "", False)]
    while stack:
        node, parent, depth, idx, place, above = stack.pop()
        own = len(rows)
        seen = _seen(parent, node.get("text"), node.get("content_desc"), node["type"])
        inherited = above or node.get("clickable") == "true"
        rows.append((
            own, parent, depth, idx, place, node["type"], node.get("text"), node.get("content_desc"), node.get("resource_id"),
            node.get("package"), node.get("class_label"), node.get("clickable"), node.get("scrollable"), node.get("displayed"),
            node.get("bounds"), not node["kids"], seen, inherited,
        ))
        stack += [(k, own, depth + 1, i, f"{place}/{i}", inherited) for i, k in reversed(list(enumerate(node["kids"])))]
    return rows


def _node_batches(batches: Iterator[pa.RecordBatch], names: list[str], types: list[pa.DataType], soup: bool) -> Iterator[pa.RecordBatch]:
    """Nodes of pages (key, source), given out as soon as there are NODES_HELD of them: only those and one more page are held."""
    for batch in batches:
        owner, made = [], []
        for at in range(len(batch)):
            rows = node_rows(batch.column(1)[at].as_py(), soup)
            owner += [at] * len(rows)
            made += rows
            if made and (len(made) >= NODES_HELD or at == len(batch) - 1):
                columns = [pa.array(c, t) for c, t in zip(zip(*made), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *columns], names)
                owner, made = [], []


def parsed(pages: DataFrame, key: str, source: str, soup: bool = False) -> DataFrame:
    """key and NODE_SCHEMA: one row per node of each page."""
    kind, names, types = dict(pages.dtypes)[key], [key, *_NAMES], [_ARROW[part.split()[1]] for part in NODE_SCHEMA.split(", ")]
    return pages.select(key, source).mapInArrow(lambda batches: _node_batches(batches, names, types, soup), f"{key} {kind}, {NODE_SCHEMA}")


def parsed_pages(pages: DataFrame, key: str, source: str, columns: list[str], soup: bool = False) -> DataFrame:
    """key, nodes: the nodes of each page that can be parsed as one array in pre-order, with the named columns of NODE_SCHEMA.

    For what is made of each page alone: its nodes need not be shuffled to come together again.
    """
    kinds = dict(part.split() for part in NODE_SCHEMA.split(", "))
    at, types = [_NAMES.index(c) for c in columns], [_ARROW[kinds[c]] for c in columns]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, ends, made = [], [0], []
            for k in range(len(batch)):
                if rows := node_rows(batch.column(1)[k].as_py(), soup):
                    made += rows
                    owner.append(k)
                    ends.append(len(made))
                if made and (len(made) >= NODES_HELD or k == len(batch) - 1):
                    values = list(zip(*made))
                    nodes = pa.StructArray.from_arrays([pa.array(values[i], t) for i, t in zip(at, types)], columns)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes)], [key, "nodes"])
                    owner, ends, made = [], [0], []

    fields = ", ".join(f"{c}: {kinds[c]}" for c in columns)
    return pages.select(key, source).mapInArrow(batches_of, f"{key} {dict(pages.dtypes)[key]}, nodes array<struct<{fields}>>")


def register_table_function(spark, name: str = "parse_ui") -> None:
    """parse_ui(xml) for SQL: SELECT ... FROM pages, LATERAL parse_ui(xml)."""

    class ParseUi:
        def eval(self, source: str):
            yield from node_rows(source)

    spark.udtf.register(name, F.udtf(ParseUi, returnType=NODE_SCHEMA))


def tag_of(type_: Column) -> Column:
    out = F.lit("div")
    for part, tag in reversed(TAGS):
        out = F.when(type_.contains(part), tag).otherwise(out)
    return out


#: What a rendered line takes of a node.
LINE_COLUMNS = ["type", "text", "content_desc", "resource_id", "package", "class_label", "clickable", "scrollable", "bounds", "is_leaf", "visible", "inherited"]


def _is_shown(of: Callable[[str], Column]) -> tuple[Column, Column]:
    """Whether a node is a visible leaf, and whether it scrolls."""
    return of("is_leaf") & of("visible"), F.coalesce(of("scrollable") == "true", F.lit(False))


def _line(of: Callable[[str], Column], with_bounds: bool, parity: bool) -> Column:
    attr = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f' {name}="'), c, F.lit('"'))).otherwise("")
    flat = lambda c: F.replace(of(c), F.lit("\n"), F.lit(""))
    tag = tag_of(of("type"))
    clickable = F.when(of("inherited"), F.lit("true")).otherwise(of("clickable"))
    leaf, scrolls = _is_shown(of)
    bounds = F.when(scrolls | F.lit(with_bounds), attr("bounds", of("bounds"))).otherwise("")
    return F.concat(
        F.lit("<"), tag, attr("id", of("resource_id")),
        F.when(leaf, attr("package", of("package"))).otherwise(""),
        attr("class", of("class_label")),
        F.when(leaf | F.lit(not parity), attr("description", flat("content_desc"))).otherwise(attr("descript  ion", flat("content_desc"))),
        attr("clickable", clickable),
        F.when(scrolls, attr("scrollable", of("scrollable"))).otherwise(""), bounds,
        F.lit("> "), F.coalesce(flat("text"), F.lit("")), F.lit(" </"), tag, F.lit(">"),
    )


def rendered_lines(nodes: DataFrame, key: str, with_bounds: bool = False, parity: bool = False) -> DataFrame:
    """key, node_id, line: one line per visible leaf and per scrollable node, in pre-order.

    with_bounds prints every leaf's bounds too. parity spells a container's description attribute
    as the stored corpora have it, in two parts.
    """
    leaf, scrolls = _is_shown(F.col)
    return nodes.filter(leaf | scrolls).select(key, "node_id", _line(F.col, with_bounds, parity).alias("line"))


def rendered_pages(pages: DataFrame, key: str, with_bounds: bool = False, parity: bool = False) -> DataFrame:
    """key, html: pages_of() over rendered_lines(), of parsed_pages() with LINE_COLUMNS; a page without lines has no row."""

    def shown(n: Column) -> Column:
        leaf, scrolls = _is_shown(n.getField)
        return leaf | scrolls

    html = F.array_join(F.transform(F.filter("nodes", shown), lambda n: _line(n.getField, with_bounds, parity)), "\n")
    return pages.filter(F.exists("nodes", shown)).select(key, F.concat(html, F.lit("\n")).alias("html"))


def pages_of(lines: DataFrame, key: str) -> DataFrame:
    """key, html: the lines of each page joined, each with its newline."""
    ordered = F.array_sort(F.collect_list(F.struct("node_id", "line")))
    return lines.groupBy(key).agg(F.concat(F.array_join(ordered["line"], "\n"), F.lit("\n")).alias("html"))


def text_boxes(nodes: DataFrame, key: str, parity: bool = False) -> DataFrame:
    """key, dump: text and box of each node that has both, in pre-order, a line each.

    With parity a node's line and the first below it are not separated.
    """
    own = nodes.filter((F.coalesce("text", F.lit("")) != "") & (F.coalesce("bounds", F.lit("")) != ""))
    line = F.concat(F.lit("<ref>"), "text", F.lit("</ref><box>"), "bounds", F.lit("</box>"))
    before = F.lag("place").over(Window.partitionBy(key).orderBy("node_id"))
    below = F.col("place").startswith(F.concat(before, F.lit("/")))
    gap = F.when(before.isNull(), "").when(below & F.lit(parity), "").otherwise("\n")
    parts = own.select(key, "node_id", F.concat(gap, line).alias("part"))
    return parts.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("node_id", "part")))["part"], "").alias("dump"))


def page_text_boxes(pages: DataFrame, key: str, parity: bool = False) -> DataFrame:
    """key, dump: text_boxes() of parsed_pages() with text, bounds and place."""
    own = F.filter("nodes", lambda n: (F.coalesce(n["text"], F.lit("")) != "") & (F.coalesce(n["bounds"], F.lit("")) != ""))
    line = lambda n: F.concat(F.lit("<ref>"), n["text"], F.lit("</ref><box>"), n["bounds"], F.lit("</box>"))

    def part(n: Column, i: Column) -> Column:
        below = n["place"].startswith(F.concat(F.get("own", i - 1)["place"], F.lit("/")))
        return F.concat(F.when(i == 0, "").when(below & F.lit(parity), "").otherwise("\n"), line(n))

    return pages.select(key, own.alias("own")).filter(F.size("own") > 0).select(key, F.array_join(F.transform("own", part), "").alias("dump"))


def nested_dump(source: str | None) -> str | None:
    """Types, texts and boxes with children in brackets; outer empty brackets are taken off."""
    rows = node_rows(source)
    if not rows:
        return None
    upper = {"img": "IMAGE", "button": "BUTTON", "input": "INPUT", "p": "P", "div": "DIV"}
    below: dict[int, list[str]] = {}
    for r in reversed(rows):
        tag = next((t for part, t in TAGS if part in r[5]), "div")
        own = f"{upper[tag]} - {r[6]} {r[14]}" if r[6] and r[14] else ""
        kids = below.pop(r[0], [])
        text = own + (" (" + ", ".join(reversed(kids)) + ")" if kids else "")
        if r[1] is not None and text:
            below.setdefault(r[1], []).append(text)
    text = text.lstrip()
    while text.startswith("( ") and text.endswith(")"):
        text = text[2:-1]
    return text


def nested_dumps(pages: DataFrame, key: str, source: str) -> DataFrame:
    """key, dump: nested_dump() of each page; null where a page cannot be parsed."""

    @F.pandas_udf("string")
    def dumped(sources: pd.Series) -> pd.Series:
        return sources.map(nested_dump)

    return pages.select(key, dumped(F.col(source)).alias("dump"))


def tree_metrics(nodes: DataFrame, key: str) -> DataFrame:
    """key, n_nodes, n_leaves, max_depth (the root has depth 1)."""
    return nodes.groupBy(key).agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"), F.max("depth").alias("max_depth"))


#: Nodes that a task of the comparisons of trees gets.
NODES_A_TASK = 1 << 18


def _tasks(nodes: DataFrame) -> int:
    """As many tasks as keep one at NODES_A_TASK, so that its memory does not grow with the table; no fewer than Spark would take."""
    return max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // NODES_A_TASK))


def tree_difference(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """a, b, unmatched, difference: nodes whose place only one tree has, over the mean number of nodes.

    pairs(a, b), each once in the result. Each side's places are joined once; what both have is counted, the rest
    follows. A page without nodes, as one that cannot be parsed, lacks all of the other's; two of them do not differ.
    """
    size = nodes.groupBy(key).agg(F.count("*").alias("n"))
    wanted = pairs.select("a", "b").distinct()
    n = _tasks(nodes)
    one = nodes.select(F.col(key).alias("a"), "place").repartition(n, "a")
    two = nodes.select(F.col(key).alias("b"), "place").repartition(n, "b", "place")
    both = wanted.repartition(n, "a").join(one, "a").repartition(n, "b", "place").join(two, ["b", "place"]).groupBy("a", "b").agg(F.count("*").alias("both"))
    sized = (
        wanted.join(both, ["a", "b"], "left")
        .join(size.select(F.col(key).alias("a"), F.col("n").alias("na")), "a", "left")
        .join(size.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b", "left")
        .na.fill(0, ["both", "na", "nb"])
    )
    unmatched = F.col("na") + F.col("nb") - 2 * F.col("both")
    mean = (F.col("na") + F.col("nb")) / 2
    return sized.select("a", "b", unmatched.alias("unmatched"), F.when(mean > 0, unmatched / mean).otherwise(0.0).alias("difference"))


def child_count_delta(pairs: DataFrame, nodes: DataFrame, key: str, stop: int | None = None) -> DataFrame:
    """a, b, delta: differences of the number of children, summed over places that both trees have.

    Pairs without a place in common, as where a page cannot be parsed, have 0. With stop the sum goes in pre-order
    and ends at the first place where it has reached stop, as a comparison that is broken off there.
    """
    n = _tasks(nodes)
    above = nodes.select(key, F.col("parent_id").alias("node_id")).filter("node_id is not null").repartition(n, key, "node_id")
    kids = above.groupBy(key, "node_id").agg(F.count("*").alias("kids"))
    full = nodes.select(key, "node_id", "place").repartition(n, key, "node_id").join(kids, [key, "node_id"], "left").select(F.col(key).alias("k"), "place", F.coalesce("kids", F.lit(0)).alias("kids"))
    one = full.select(F.col("k").alias("a"), "place", F.col("kids").alias("ka")).repartition(n, "a")
    two = full.select(F.col("k").alias("b"), "place", F.col("kids").alias("kb")).repartition(n, "b", "place")
    wanted = pairs.select("a", "b").distinct()
    met = wanted.repartition(n, "a").join(one, "a").repartition(n, "b", "place").join(two, ["b", "place"]).select("a", "b", "place", F.abs(F.col("ka") - F.col("kb")).alias("d"))
    if stop is not None:
        # Pre-order: child indexes compared as numbers, a place before those below it.
        steps = F.transform(F.filter(F.split("place", "/"), lambda s: s != ""), lambda s: s.cast("int"))
        upto = Window.partitionBy("a", "b").orderBy(steps).rowsBetween(Window.unboundedPreceding, -1)
        met = met.withColumn("before", F.coalesce(F.sum("d").over(upto), F.lit(0))).filter(F.col("before") < stop)
    sums = met.groupBy("a", "b").agg(F.sum("d").alias("delta"))
    return wanted.join(sums, ["a", "b"], "left").select("a", "b", F.coalesce("delta", F.lit(0)).alias("delta"))
