"""Upper case by single characters, as the SQL has it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import simple_upper
from corpusloom.plans import catalog

TEXTS = ["Straße", "ß", "ŉaﬁ ΐ", "plain ñ", "ẞß" * 3, "ᾳᾼև\nß", "", None]


def test_upper_case_equals_duckdb(spark):
    got = [r[0] for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1).select(simple_upper(F.col("t"))).collect()]
    assert got == [duckdb.execute("select upper(?::varchar)", [t]).fetchone()[0] for t in TEXTS]


@pytest.mark.parametrize("more", [0, 10_001])
def test_sharp_s_is_no_double_s(spark, tmp_path, more):
    names = ["Ss one", "Straße two", "ass", *[f"n{i}x" for i in range(more)]]
    texts = ["Fußball", "Klasse", "auf der straße", "STRASSE", None]
    spark.createDataFrame(list(enumerate(names)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["app_api_lookup"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalog.ORACLE_SQL["app_api_lookup"]).fetchall())
