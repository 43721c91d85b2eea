"""Nodes leave the parser in small batches, whatever the number of pages in one of Spark's."""

import pyarrow as pa

from corpusloom.operators import uitree


def test_nodes_leave_before_all_pages_are_parsed(spark):
    pages = [(i, None if i % 7 == 0 else "<div>" + f"<p>n{i}</p>" * (i % 5) + "</div>") for i in range(9_000)]
    names = ["page", *uitree._NAMES]
    types = [uitree._ARROW[part.split()[1]] for part in uitree.NODE_SCHEMA.split(", ")]
    batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in pages]), pa.array([s for _, s in pages])], ["page", "html"])
    made = list(uitree._node_batches(iter([batch]), names, types, True))
    assert len(made) > 4 and max(map(len, made)) < uitree.NODES_HELD + 10
    want = [(p, *row) for p, s in pages for row in uitree.node_rows(s, True)]
    assert [tuple(r.values()) for m in made for r in m.to_pylist()] == want
    rows = spark.createDataFrame(pages, "page long, html string")
    assert sorted(map(repr, map(tuple, uitree.parsed(rows, "page", "html", soup=True).collect()))) == sorted(map(repr, want))
