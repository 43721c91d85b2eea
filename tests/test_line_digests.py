"""Line sets meet by digests: no text of a line is shuffled or written."""

from corpusloom.operators import retrieval


def test_only_digests_are_written(spark, monkeypatch):
    kept = []

    def seen(df, tag, made=retrieval.written):
        kept.append(df.schema["lines"].dataType.simpleString())
        return made(df, tag)

    monkeypatch.setattr(retrieval, "written", seen)
    rows = [(0, ["a", "b", "c"]), (1, ["c", "b", "d"]), (2, ["a", "b", "c"]), (3, ["e"]), (4, [""])]
    sets = spark.createDataFrame(rows, "doc_id long, lines array<string>").selectExpr("doc_id", "lines", "size(lines) as n")
    assert sorted((r.a, r.b, r.common) for r in retrieval.jaccard_pairs(sets, 0.4).collect()) == [(0, 1, 2), (0, 2, 3), (1, 2, 2)]
    assert {r.doc_id: (r.class_id, r.linked) for r in retrieval.jaccard_classes(sets, 0.4).collect()} == {0: (0, 2), 1: (1, 2), 2: (0, 2), 3: (3, 0), 4: (4, 0)}
    assert set(kept) == {"array<binary>"}
