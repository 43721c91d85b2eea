"""Comparisons of trees take more tasks as there are more nodes."""

from corpusloom.operators import uitree


def test_tasks_follow_the_nodes(spark, monkeypatch):
    nodes = spark.createDataFrame([(p, k, None if k == 0 else 0, "" if k == 0 else f"/{k - 1}") for p in range(40) for k in range(1 + p % 5)], "page long, node_id int, parent_id int, place string")
    pairs = spark.createDataFrame([(p, p + 1) for p in range(-1, 40)], "a long, b long")
    rows = lambda: (sorted(map(tuple, uitree.child_count_delta(pairs, nodes, "page").collect())), sorted(map(tuple, uitree.tree_difference(pairs, nodes, "page").collect())))
    want = rows()
    monkeypatch.setattr(uitree, "NODES_A_TASK", 10)
    assert uitree._tasks(nodes) == 12 and rows() == want
    for made in (uitree.child_count_delta(pairs, nodes, "page"), uitree.tree_difference(pairs, nodes, "page")):
        assert "(b" in (plan := made._jdf.queryExecution().executedPlan().toString()) and ", 12), REPARTITION_BY_NUM" in plan
