"""A catalogue of more names than one list takes."""

from corpusloom.plans import catalog


def test_large_catalogue_is_looked_up_whole(spark, tmp_path):
    names = [f"n{i}x" for i in range(20_050)]
    texts = ["see N7X and an20049xb", "n12345x n12345x", "nothing here", None, "", " ".join(names[9990:10_040])]
    spark.createDataFrame([(i, f"{n} of words") for i, n in enumerate([*names, names[3]])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.QUERIES["app_api_lookup"](spark, str(tmp_path)).collect()))
    assert got == sorted((i, n.upper()) for i, t in enumerate(texts) for n in names if n.upper() in (t or "").upper())
