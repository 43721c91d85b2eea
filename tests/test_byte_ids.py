"""Token ids by bytes take a step for each byte, however long the text is."""

import time

from corpusloom.operators import corpus


def test_long_texts(spark):
    text = "aé\n\0😀" * 40_000
    rows = spark.createDataFrame([(0, [("user", text), ("assistant", ""), ("user", None)])], "k int, conversations array<struct<from:string,value:string>>")
    start = time.time()
    got = corpus.chat_ids(rows.filter("k = 0").selectExpr("k", "slice(conversations, 1, 2) as conversations"), "k", None).first()
    head = [256, *b"system", 10, *b"You are a helpful assistant.", 257, 10]
    assert got.input_ids == [*head, 256, *b"user", 10, *text.encode(), 257, 10, 256, *b"assistant", 10, 257, 10]
    assert time.time() - start < 30  # before, a step for each pair of bytes
    assert spark.createDataFrame([(None,)], "t string").select(corpus.byte_ids("t")).first()[0] == []
