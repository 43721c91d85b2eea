"""Shards of a frontier and classes of equal line sets."""

from pyspark.sql import functions as F

from corpusloom.operators import graph, retrieval


def test_a_worker_reads_and_writes_its_own_shards_only(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = spark.range(90).select("id", (F.col("id") % 9).cast("int").alias("shard"), F.lit(False).alias("done"))
    graph.write_shards(rows, path, "shard")
    kept = sorted(f.name for f in (tmp_path / "f/shard=5").glob("*.parquet"))
    graph.write_shards(spark.createDataFrame([(3, 3, True)], "id long, shard int, done boolean"), path, "shard")
    assert sorted(f.name for f in (tmp_path / "f/shard=5").glob("*.parquet")) == kept
    mine = graph.read_shards(spark, path, "shard", [3, 5])
    assert "PartitionFilters: [" in (plan := mine._jdf.queryExecution().toString()) and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all("shard=3" in f or "shard=5" in f for f in mine.select("id").inputFiles()) or mine.count() == 11
    assert sorted((r.id, r.done) for r in mine.collect()) == sorted([(3, True)] + [(i, False) for i in range(5, 90, 9)])


def test_equal_pages_are_one_class_and_no_pair(spark):
    rows = [(i, ["a", "b", "c", "d"]) for i in range(300)] + [(300 + i, ["a", "b", "c", f"x{i % 2}"]) for i in range(6)] + [(400, ["z"]), (401, []), (402, [])]
    sets = retrieval.line_sets(spark.createDataFrame(rows, "doc_id long, t array<string>"), F.col("t"))
    got = {r.doc_id: (r.class_id, r.copies, r.linked) for r in retrieval.jaccard_classes(sets, 0.5).collect()}
    assert got[7] == (0, 300, 299 + 6) and got[303] == (301, 3, 2 + 3 + 300) and got[400] == (400, 1, 0) and got[402] == (401, 2, 0)
    assert len(got) == len(rows)
