"""The ordered pass over an app's pages is given the lines that several pages have, and gives what whole lines give."""

import math
import random

from corpusloom.operators import canonical


def _plain(pages: list[tuple[int, list[str]]]) -> dict[int, int]:
    """The pass over whole lines, without parents and images."""
    kept: list[tuple[int, list[str]]] = []
    unique = {}
    for page, lines in pages:
        n, mean = len(kept), sum(len(x) for _, x in kept) / len(kept) if kept else 1
        score = []
        for at, (_, held) in enumerate(kept):
            total = 0.0
            for line in dict.fromkeys(lines):
                df = sum(line in x for _, x in kept)
                f = held.count(line)
                total += lines.count(line) * math.log((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(held) / (mean or 1)))
            score.append((-round(total, 9), at))
        best = kept[min(score)[1]] if score else None
        if best and len(set(lines) & set(best[1])) / (len(set(lines) | set(best[1])) or 1) > 0.5:
            unique[page] = best[0]
        else:
            unique[page] = page
            kept.append((page, lines))
    return unique


def test_pass_equals_whole_lines(spark):
    rng = random.Random(4)
    pages = [(k, [rng.choice("abcdefgh") if rng.random() < 0.8 else f"own {k} {i}" for i in range(rng.randrange(6))]) for k in range(80)]
    df = spark.createDataFrame([(app, k, None, k, lines, None) for app in ("x", None) for k, lines in pages], "app string, page_id long, parent_id long, seq long, lines array<string>, image array<int>")
    got = canonical.online(df, "app").collect()
    for app in ("x", None):
        assert {r.page_id: r.unique_id for r in got if r.app == app} == _plain(pages)


def test_lines_of_one_page_stay_out_of_the_pass(spark):
    rows = [("x", 0, None, 0, ["both", "one", "one"], None), ("x", 1, None, 1, ["both", "two"], None), ("y", 2, None, 2, ["both"], None)]
    df = spark.createDataFrame(rows, "app string, page_id long, parent_id long, seq long, lines array<string>, image array<int>")
    got = {r.page_id: (len(r.shared or []), r["size"], r.distinct) for r in canonical._shared(df).collect()}
    assert got == {0: (1, 3, 2), 1: (1, 2, 2), 2: (0, 1, 1)}
