"""Small tables with everything that must not crash an operator."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, size long, h long, key string, "
    "node long, root long, spans string, keys string, doc string, _digest string, target double, limit long, fold long, line string"
)


def documents(spark, texts, ids=None, sources=None, langs=None):
    """documents with extra columns whose names the operators use themselves."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    rows = [
        (ids[i], t, langs[i] if langs else "en", sources[i] if sources else f"src{i % 3}", len(t or ""), "d", 7, 8, 9, "k", 1, 2, "s", "ks", "x", "y", 0.5, 3, 4, "l")
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(rng: random.Random) -> list[str | None]:
    base = prose(rng, 120)
    long = prose(rng, 6000, 5000)
    return [
        None, "", " \n\t ", "x", "x", "one two", base, base, base.replace(" ", "\n"), base + " tail", long, long + " end",
        "é漢字 🙂 ñ" * 40, "a" * 3000, "== " * 500, "\x0b\x0c\r", "Word", "word", "\x1fq\x85 z", "no space" * 300, None, base.upper(),
    ]
