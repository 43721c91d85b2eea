import json
import os

from pyspark.sql import functions as F

from corpusloom.operators import elements, graph, uitree
from corpusloom.sources import files
from corpusloom.streaming import upsert

XML = """<hierarchy><android.widget.FrameLayout clickable="true" bounds="[0,0][9,9]"><android.widget.TextView text="Hi&#10;there"
resource-id="t" package="p" class="C" bounds="[1,1][2,2]"/><android.widget.ImageButton bounds="[3,3][4,4]"/></android.widget.FrameLayout>
<android.widget.ScrollView scrollable="true" content-desc="list" package="p" bounds="[5,5][6,6]"><android.view.View/></android.widget.ScrollView></hierarchy>"""


def pages(spark, *xml):
    return spark.createDataFrame(list(enumerate(xml)), "page_id long, xml string")


def test_nodes_in_pre_order(spark):
    rows = uitree.parsed(pages(spark, XML, "<broken", None, "<!DOCTYPE x><a/>"), "page_id", "xml").orderBy("page_id", "node_id").collect()
    assert {r.page_id for r in rows} == {0} and [r.node_id for r in rows] == list(range(6))
    assert [r.parent_id for r in rows] == [None, 0, 1, 1, 0, 4] and [r.depth for r in rows] == [1, 2, 3, 3, 2, 3]
    assert [r.visible for r in rows] == [True, False, True, True, True, False]
    assert [r.inherited for r in rows] == [False, True, True, True, False, False]


def test_rendered_lines(spark):
    nodes = uitree.parsed(pages(spark, XML), "page_id", "xml")
    got = [r.line for r in uitree.rendered_lines(nodes, "page_id").orderBy("node_id").collect()]
    assert got == [
        '<p id="t" package="p" class="C" clickable="true"> Hithere </p>',
        '<button clickable="true">  </button>',
        '<div description="list" scrollable="true" bounds="[5,5][6,6]">  </div>',
    ]
    parity = uitree.pages_of(uitree.rendered_lines(nodes, "page_id", with_bounds=True, parity=True), "page_id").first().html
    assert 'descript  ion="list"' in parity and 'bounds="[1,1][2,2]"' in parity and parity.endswith("\n")


def test_dumps(spark):
    xml = '<a text="x" bounds="[0,0][1,1]"><b text="y" bounds="[2,2][3,3]"/><c text="" bounds="[4,4][5,5]"/><d text="z" bounds="[6,6][7,7]"/></a>'
    nodes = uitree.parsed(pages(spark, xml), "page_id", "xml")
    x, y, z = (f"<ref>{t}</ref><box>{b}</box>" for t, b in (("x", "[0,0][1,1]"), ("y", "[2,2][3,3]"), ("z", "[6,6][7,7]")))
    assert uitree.text_boxes(nodes, "page_id").first().dump == f"{x}\n{y}\n{z}"
    assert uitree.text_boxes(nodes, "page_id", parity=True).first().dump == f"{x}{y}\n{z}"
    assert uitree.nested_dump(xml) == "DIV - x [0,0][1,1] (DIV - y [2,2][3,3], DIV - z [6,6][7,7])"
    assert uitree.nested_dump("<a><b><c text='q' bounds='[1,1][2,2]'/></b></a>") == "(DIV - q [1,1][2,2])"


def test_pages_nested_deeper_than_calls(spark):
    deep = "<a>" * 4000 + "</a>" * 4000
    nodes = uitree.parsed(pages(spark, deep, XML), "page_id", "xml")
    m = {r.page_id: r for r in uitree.tree_metrics(nodes, "page_id").collect()}
    assert (m[0].n_nodes, m[0].n_leaves, m[0].max_depth) == (4000, 1, 4000) and m[1].n_nodes == 6
    dumps = {r.page_id: r.dump for r in uitree.nested_dumps(pages(spark, deep, XML, None, "<broken"), "page_id", "xml").collect()}
    assert dumps[1] == uitree.nested_dump(XML) and dumps[0] == "" and dumps[2] is None and dumps[3] is None


def test_tree_difference_counts_whole_subtrees(spark):
    one, two = "<a><b/><c/></a>", "<a><b/><c/><d><e/><f/></d></a>"
    nodes = uitree.parsed(pages(spark, one, two), "page_id", "xml")
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    r = uitree.tree_difference(pairs, nodes, "page_id").first()
    assert r.unmatched == 3 and abs(r.difference - 3 / 4.5) < 1e-12
    assert uitree.child_count_delta(pairs, nodes, "page_id").first().delta == 1


def test_soup_closes_what_is_open(spark):
    rows = uitree.node_rows("<div><p>one<br>two</div></span><img alt='i'>", soup=True)
    assert [(r[5], r[2]) for r in rows] == [("document", 1), ("div", 2), ("p", 3), ("br", 4), ("img", 2)]


def test_table_function(spark):
    uitree.register_table_function(spark)
    pages(spark, XML).createOrReplaceTempView("ui_pages")
    assert spark.sql("select page_id, type from ui_pages, lateral parse_ui(xml)").count() == 6


def test_elements_to_actions(spark):
    html = ['<p class="a" clickable="true"> x </p>', "<p> no </p>", '<div class="s" scrollable="true">  </div>', '<input class="i">  </input>', '<b clickable="true"> nameless </b>']
    df = spark.createDataFrame([(1, html)], "page long, lines array<string>")
    e = elements.categorised(elements.numbered(df, "page", F.col("lines")))
    assert {r.idx: (r.category, r.description) for r in e.collect()} == {1: ("Clickables", "x"), 2: ("Scrollables", "Empty s"), 3: ("Inputs", "Empty i")}
    got = [r.action for r in elements.actions(e, "page", ["t", "t"]).orderBy("ord").collect()]
    assert got == ["click(1)", "scroll(2,up)", "scroll(2,down)", "scroll(2,left)", "scroll(2,right)", "click(3)", "input(3,t)"]


def test_labels_take_the_first_place(spark):
    df = spark.createDataFrame([(1, '<p clickable="true"> a </p>\n<p clickable="true"> a </p>\nrest', 'x bounds="[1,1][2,2]"\ny bounds="[3,3][4,4]"')], "k long, one string, two string")
    rows = elements.element_labels(elements.zipped_lines(df, "k", "one", "two"), "k").collect()
    assert [(r.label, r.box) for r in rows] == [("a", "[1,1][2,2]")]


def test_sampled_key_prefers_typing(spark):
    rows = [(1, "发送", "click"), (1, "name", "bob"), (2, "发送", "click"), (2, "Send", "click"), (3, "Send", "click")]
    df = spark.createDataFrame(rows, "page long, key string, action_type string")
    assert {(r.page, r.key) for r in elements.sampled_key(df, "page", "s").collect()} == {(1, "name"), (2, "发送")}


def test_maps_keep_what_they_encode(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'q"uo\\te'), ("b", "é\n")], "key string, value string")
    files.write_map(rows, str(tmp_path / "m"))
    text = "".join(open(tmp_path / "m" / f).read() for f in os.listdir(tmp_path / "m") if f.startswith("part"))
    assert json.loads(json.loads(text)) == {"a": 'q"uo\\te', "b": "é\n"}
    assert {tuple(r) for r in files.read_map(spark, str(tmp_path / "m")).collect()} == {tuple(r) for r in rows.collect()}


def test_page_folders(spark, tmp_path):
    for name, size in (("p1", 2000), ("p2", 10)):
        d = tmp_path / "app" / name
        d.mkdir(parents=True)
        (d / f"{name}-html.txt").write_text("<p> x </p>")
        (d / f"{name}-screen.png").write_bytes(b"0" * size)
        (d / f"{name}.json").write_text("{}")
    (tmp_path / "app" / "p3-xml.txt").write_text("<a/>")
    got = {r.page_name: r for r in files.read_pages(spark, str(tmp_path), {"screen": 1024}).collect()}
    assert set(got) == {"p1", "p2"} and len(got["p1"].screen) == 2000 and got["p2"].screen is None
    assert files.list_files(spark, str(tmp_path), "*.png").count() == 2


def test_tables_logs_and_catalogues(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "key string, value long")
    assert files.write_dictionary(rows, str(tmp_path / "d")) == 2
    files.append_rows(rows, str(tmp_path / "log"))
    files.append_rows(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    (tmp_path / "q.csv").write_text("﻿id,question\n1,\"a, b\"\n")
    assert files.read_csv(spark, str(tmp_path / "q.csv")).first().asDict() == {"id": "1", "question": "a, b"}
    (tmp_path / "l.txt").write_text("  a \n b\t\n")
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b"]
    files.write_lines(files.read_lines(spark, str(tmp_path / "l.txt")), str(tmp_path / "lines"))
    files.write_json(rows, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "l2.json") if (tmp_path / "l2.json").write_text('{"a": 1}') else "").first().a == 1
    coco = {"images": [{"id": 1, "file_name": "f", "width": 9, "height": 9}], "categories": [{"id": 5, "name": "cup"}, {"id": 6, "name": "cat"}], "annotations": [{"id": i, "image_id": 1, "category_id": c, "bbox": [1.0, 2.0, 3.0, 4.0], "iscrowd": 0} for i, c in enumerate((5, 5, 6))]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    notes = files.read_coco(spark, str(tmp_path / "c.json"))
    assert [r.category for r in files.alone_in_group(notes, "image_id", "category").collect()] == ["cat"]
    (tmp_path / "t.json").write_text(json.dumps([{"id": "1", "app": "a", "query": "q", "check_point": {"text": "x", "api": ["y", "z"]}}]))
    assert files.read_tasks(spark, str(tmp_path / "t.json")).first().check_point == {"text": ["x"], "api": ["y", "z"]}
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"name_en": "m", "adb": ["p"], "text": ["1"]}, {"name_en": "m", "adb": ["q"], "text": []}]}))
    assert [r.adb for r in files.read_apps(spark, str(tmp_path / "a.json")).collect()] == [["p"]]
    assert spark.range(1).select(files.data_url(F.lit("x" * 90).cast("binary"))).first()[0].count("\n") == 0
    assert files.with_usage_time(spark.sql("select timestamp'2024-01-02 03:04:05' ts")).first().timestamp == "2024-01-02 03:04:05"


def test_chunks_leave_the_remainder_to_the_last(spark):
    for total, parts in ((10, 3), (2, 5), (6, 3), (0, 2)):
        got = [r.c for r in spark.range(total).select(graph.chunk_of(F.col("id"), F.lit(total), parts).alias("c")).collect()]
        size = total // parts
        assert got == [min(i // size, parts - 1) if size else parts - 1 for i in range(total)]


def test_ids_are_dense_and_checked(spark):
    log = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, seq long")
    ids = graph.first_seen_ids(log, "k", "seq")
    assert {r.k: r.id for r in ids.collect()} == {"b": 0, "a": 1, "c": 2}
    assert graph.integrity(ids).first().violations == 0
    assert graph.integrity(ids.filter("k <> 'a'")).first().violations > 0
    assert graph.integrity(ids.filter("false")).first().violations == 0


def test_upserts_keep_the_newest_row_and_survive_a_repeat(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = upsert.upsert_to(path, ["k"], "seq")
    merge(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq long, v string"), 0)
    for _ in range(2):
        merge(spark.createDataFrame([("a", 3, "w")], "k string, seq long, v string"), 1)
    assert {r.k: r.v for r in upsert.latest(spark, path).collect()} == {"a": "w", "b": "z"}


def test_windowed_counts_over_a_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    got = upsert.run_once(upsert.windowed_counts(stream), str(tmp_path / "c"), "windowed")
    assert got.agg(F.sum("visits")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
