"""Texts go to the workers that encode them in batches of a bounded number, and what these remember is packed."""

from corpusloom.functions import bpe
from corpusloom.plans import catalog
from corpusloom.plans.corpus_queries import BYTE_LEVEL


def test_batches_and_words_are_small(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    catalog.QUERIES["vocabulary_round_trip"](spark, sf_dir)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    known = bpe.read(BYTE_LEVEL)
    first, again = known.encode("some words some words"), known.encode("some words")
    assert all(ids.itemsize == 4 for ids in known.known.values()) and known.decode(first).decode() == "some words some words" and type(again) is list
