"""Running means of groups of any size, and holds over tries."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from corpusloom.operators import corpus, graph


def test_means_of_hot_and_small_groups(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.choice([None, 1.5, 2.25, -7.0])) for i in range(2000)] + [(f"g{i % 40}", i, float(i)) for i in range(300)] + [(None, i, 1.0 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, seq long, v double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.seq): r.running for r in corpus.running_mean(df, "v", "seq", "g").collect()}
        exact = {(r.g, r.seq): r.running for r in corpus.running_mean(df.withColumn("v", F.col("v").cast("decimal(12,4)")), "v", ["seq"], "g").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    had = {}
    for g, seq, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s, n = had.get(g, (0.0, 0))
        had[g] = s, n = (s, n) if v is None else (s + v, n + 1)
        assert got[g, seq] == exact[g, seq] is None if not n else abs(got[g, seq] - s / n) < 1e-9 and abs(exact[g, seq] - Decimal(s) / n) < Decimal("0.0001")
    assert len(got) == len(rows)
    assert corpus.running_mean(df.filter("false"), "v", "seq", "g").count() == 0


def test_a_hot_group_is_on_many_ranges(spark):
    df = spark.range(5000).select(F.lit("one").alias("g"), F.col("id").alias("seq"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as where the ranges are large
    try:
        ranged = df.repartitionByRange("g", "seq").groupBy(F.spark_partition_id()).count()
        assert ranged.count() > 1
        assert corpus.running_mean(df, "v", "seq", "g").filter("abs(running - seq / 2) > 1e-9").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_holds_reach_below_them_in_any_trie(spark):
    rng = random.Random(4)
    parent = {i: (rng.randrange(i) if rng.random() < 0.5 else i - 1) if i else None for i in range(200)}
    depth = {}
    for i, p in parent.items():
        depth[i] = 0 if p is None else depth[p] + 1
    pages = [(str(i), None if p is None else str(p), depth[i], rng.randrange(1000)) for i, p in parent.items()]
    holds = [(str(rng.randrange(200)), rng.randrange(800)) for _ in range(15)]
    nodes = spark.createDataFrame(pages, "node string, parent string, depth int, page_id long")
    got = {r.node: r.hold for r in graph.held_by_ancestor(nodes, spark.createDataFrame(holds, "node string, since long")).collect()}

    def above(i):
        while i is not None:
            yield str(i)
            i = parent[i]

    assert got == {n: any(h in set(above(int(n))) and page >= since for h, since in holds) for n, _, _, page in pages}


def test_equal_paths_have_one_node(spark):
    steps = ["a", "b", "a", "c"] * 3
    log = spark.createDataFrame([(u, i, s) for u in (1, 2) for i, s in enumerate(steps)], "u int, i int, s string")
    rows = graph.path_nodes(log, "u", "s", "i").orderBy("u", "i").collect()
    assert len({r.node for r in rows}) == 24
    assert [r.parent for r in rows] == [None, *[r.node for r in rows[:11]], None, *[r.node for r in rows[12:23]]]
    assert [r.steps for r in rows[:12]] == list(range(1, 13)) and {r.first for r in rows} == {"a"}
    again = graph.path_nodes(log.withColumn("i", F.col("i") + 100), "u", "s", "i").orderBy("u", "i").collect()
    assert [r.node for r in again] == [r.node for r in rows]
