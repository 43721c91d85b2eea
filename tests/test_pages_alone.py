"""What is made of one page's nodes alone is the same without a shuffle of nodes."""

from corpusloom.operators import uitree


def _page(k: int) -> str | None:
    if k % 9 == 0:
        return None if k % 2 else "<broken"
    leaf = "".join(f'<a.TextView text="t{i}&#10;x" bounds="[{i},0]" content-desc="d" package="p" scrollable="{"true" if i == 2 else "false"}"/>' for i in range(k % 5))
    return f'<h><f clickable="{"true" if k % 3 else "false"}" text="up" bounds="[9]">{leaf}<g scrollable="true" content-desc="s">{leaf}</g><a.Button/></f></h>'


def test_rendered_pages_and_text_boxes(spark):
    pages = spark.createDataFrame([(k, _page(k)) for k in range(60)], "page long, xml string")
    nodes, whole = uitree.parsed(pages, "page", "xml"), uitree.parsed_pages(pages, "page", "xml", [*uitree.LINE_COLUMNS, "place"])
    for bounds in (False, True):
        for parity in (False, True):
            want = uitree.pages_of(uitree.rendered_lines(nodes, "page", bounds, parity), "page")
            made = uitree.rendered_pages(whole, "page", bounds, parity)
            assert sorted(made.collect()) == sorted(want.collect()) and made.count() > 40
            assert sorted(uitree.page_text_boxes(whole, "page", parity).collect()) == sorted(uitree.text_boxes(nodes, "page", parity).collect())
    assert "Exchange" not in uitree.rendered_pages(whole, "page")._jdf.queryExecution().executedPlan().toString()
