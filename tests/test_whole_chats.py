"""The query on training ids takes texts to their ends; only short rows are filled up."""

import __spark_entry__
from corpusloom.operators import corpus

HEAD = [256, *b"system", 10, *b"You are a helpful assistant.", 257, 10]
HEAD_LABELS = [256, *[-100] * (len(HEAD) - 3), 257, 10]


def test_rows_are_whole(spark, tmp_path):
    asked, told = "é 😀 " * 90, "answer " * 70 + "the end"
    rows = [(1, 0, "user", asked), (1, 1, "assistant", told), (2, 0, "user", "x"), (3, 0, "system", "quiet " * 40)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in __spark_entry__.queries()["chatml_ids"](spark, str(tmp_path)).collect()}
    q, a = asked.encode(), told.encode()
    ids = {1: [*HEAD, 256, *b"user", 10, *q, 257, 10, 256, *b"assistant", 10, *a, 257, 10], 2: [*HEAD, 256, *b"user", 10, *b"x", 257, 10], 3: HEAD}
    labels = {
        1: [*HEAD_LABELS, 256, *[-100] * (5 + len(q)), 257, 10, 256, *[-100] * 10, *a, 257, 10],
        2: [*HEAD_LABELS, 256, *[-100] * 6, 257, 10], 3: HEAD_LABELS,
    }
    assert len(got) == 3 and len(ids[1]) > 96
    for k, r in got.items():
        room = max(96 - len(ids[k]), 0)
        assert r.input_ids == ",".join(map(str, ids[k] + [258] * room))
        assert r.labels == ",".join(map(str, labels[k] + [-100] * room))
        assert r.attended == len(ids[k])


def test_rows_are_cut_where_asked(spark):
    talks = spark.createDataFrame([(1, [("user", "a" * 100)])], "k int, conversations array<struct<from:string,value:string>>")
    whole, cut = corpus.chat_ids(talks, "k", 60, cut=False).first(), corpus.chat_ids(talks, "k", 60).first()
    assert whole.input_ids == [*HEAD, 256, *b"user", 10, *b"a" * 100, 257, 10] and all(whole.attention_mask)
    assert cut.input_ids == whole.input_ids[:60] and cut.labels == whole.labels[:60] and len(cut.attention_mask) == 60
