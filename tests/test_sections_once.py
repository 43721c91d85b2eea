"""Printed sections are taken apart once a text, however often their lines are used."""

from pyspark.sql import functions as F

from corpusloom.operators import elements
from corpusloom.plans import catalog


def test_each_text_is_split_once(spark, sf_dir):
    plan = catalog.QUERIES["section_recall"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2 and "aggregate(" not in plan


def test_heads_in_any_order_blank_lines_and_nothing(spark):
    heads = {"c:": "c", "i:": "i"}
    texts = ["lost\nc: x\n one \n\ni:\ntwo\nc:\nthree\nthree", "", "c:", None, "i:\na"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.m for r in rows.select("k", elements.parsed_sections(F.col("t"), heads).alias("m")).collect()}
    assert got[0] == {"c": ["one", "three", "three"], "i": ["two"]}
    assert got[1] == got[2] == {"c": [], "i": []} and got[4] == {"c": [], "i": ["a"]}
    assert got[3] in (None, {"c": None, "i": None})
