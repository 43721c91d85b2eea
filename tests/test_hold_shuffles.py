"""Holds of walks come with the paths: one shuffle and nothing written between."""

from corpusloom.operators import graph
from corpusloom.plans import catalog


def test_one_shuffle(spark, sf_dir):
    held = catalog.QUERIES["flag_hold_prefix"](spark, sf_dir)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1
    assert held.inputFiles() == spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles()


def test_held_from_the_first_hold_on(spark):
    rows = [(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, None), (2, 2, False), (3, 9, True), (3, 4, None)]
    log = spark.createDataFrame(rows, "who long, seq long, stop boolean")
    got = {(r.who, r.seq): r.hold for r in graph.held_on_walks(log, "who", "seq", log["stop"]).collect()}
    assert got == {(1, 1): False, (1, 2): True, (1, 3): True, (2, 1): False, (2, 2): False, (3, 4): False, (3, 9): True}
