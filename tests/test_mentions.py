"""Names that are looked for by parts of words, against a plain search."""

import random

from corpusloom.operators import corpus


def test_mentions_equal_a_plain_search(spark):
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("abé") for _ in range(n))
    names = sorted({made(rng.randint(1, 12)) for _ in range(80)} | {"tab\tin", "x" * 30})
    texts = [" ".join(made(rng.randint(0, 30)) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    texts += [None, "", "   ", "a tab\tin b", "y" + "x" * 40, texts[3]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    entries = spark.createDataFrame([(n,) for n in [*names, names[0], "", None]], "entry string")
    got = sorted(map(tuple, corpus.mentions(rows, "id", "body", entries, "entry").collect()))
    assert got == sorted((i, n) for i, t in enumerate(texts) for n in names if n in (t or ""))
    assert corpus.mentions(rows, "id", "body", entries.limit(0), "entry").count() == 0
    assert corpus.mentions(rows.limit(0), "id", "body", entries, "entry").count() == 0
