"""Canonical pages: which page stands for which, in order of arrival.

offline() compares lines only and settles in rounds (containment.py). online() is one ordered pass over each app's pages in a
grouped map: a page is compared with its parent first, then with the best candidate by BM25 among the canonical pages so
far, whose number and mean length weigh every score, so each step needs all steps before it. An app's pages are what one crawl
collects.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.containment import canonical_of
from corpusloom.storage import written

#: Defaults: line-set similarity above which pages are the same, element difference below which images are.
LINES_ABOVE, IMAGE_BELOW, CONTAINED_ABOVE = 0.5, 0.3, 0.9


def _known(lines: str) -> Column:
    """Lines as an array without nulls: a page of unknown text has none, and is like no other page."""
    return F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.isNotNull()).alias(lines)


class _Candidates:
    """BM25 over the canonical pages of one app, added one at a time. Lines are numbers; those that no other page has need not be given."""

    def __init__(self, k1: float = 1.5, b: float = 0.75):
        self.k1, self.b = k1, b
        self.postings: dict[int, tuple[array, array]] = {}
        self.sizes, self.total, self.length = array("q"), array("d"), 0

    def add(self, lines: array, size: int) -> None:
        for line, n in Counter(lines).items():
            pages, times = self.postings.setdefault(line, (array("q"), array("q")))
            pages.append(len(self.sizes))
            times.append(n)
        self.sizes.append(size)
        self.length += size

    def best(self, lines: array) -> int | None:
        if not self.sizes:
            return None
        n, mean = len(self.sizes), self.length / len(self.sizes) or 1
        self.total.extend([0.0] * (n - len(self.total)))
        total, sizes, touched = np.frombuffer(self.total), np.frombuffer(self.sizes, np.int64), []
        for line, times in Counter(lines).items():
            pages, counts = (np.frombuffer(x, np.int64) for x in self.postings.get(line, ((array("q"),) * 2)))
            if len(pages):
                idf = math.log((n - len(pages) + 0.5) / (len(pages) + 0.5) + 1)
                total[pages] += times * idf * counts * (self.k1 + 1) / (counts + self.k1 * (1 - self.b + self.b * sizes[pages] / mean))
                touched.append(pages)
        if not touched:
            return 0
        met = np.unique(np.concatenate(touched))
        score = total[met]
        total[met] = 0
        near = met[score >= score.max() - 1e-8]  # only these can be first once rounded
        return min(zip(near.tolist(), score[score >= score.max() - 1e-8].tolist()), key=lambda x: (-round(x[1], 9), x[0]))[0]


def _shared(pages: DataFrame) -> DataFrame:
    """pages(app, .., lines) with shared, size and distinct instead of lines: the digests of the lines that an app has on other rows too, and counts of all.

    A line of one row leads to no other page and is in no intersection, so only its count matters.
    """
    digests = F.transform("lines", lambda x: F.unhex(F.md5(x.cast("binary"))))
    rows = written(pages.withColumn("lines", digests).withColumn("_row", F.monotonically_increasing_id()), "pages")
    each = rows.select(F.struct("app").alias("_app"), "_row", F.posexplode("lines").alias("pos", "line"))  # null equals null in a struct
    often = each.groupBy("_app", "line").agg(F.min("_row").alias("lo"), F.max("_row").alias("hi")).filter("lo <> hi")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))["line"]
    kept = each.join(often, ["_app", "line"], "left_semi").groupBy("_row").agg(ordered.alias("shared"))
    counts = rows.withColumn("size", F.size("lines")).withColumn("distinct", F.size(F.array_distinct("lines"))).drop("lines")
    return counts.join(kept, "_row", "left").drop("_row")


def online(pages: DataFrame, app: str, limit: float = LINES_ABOVE, image_below: float = IMAGE_BELOW) -> DataFrame:
    """app, page_id, unique_id from pages(app, page_id, parent_id, seq, lines, image).

    A page like its parent takes the parent's canonical page; else its best candidate, if alike;
    else it is canonical itself. image may be null: then lines decide alone. The pass holds the numbers of the lines that
    several pages have, not their texts.
    """

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "page_id"], kind="stable")
        index, canon, unique, seen = _Candidates(), [], {}, {}
        numbers: dict[bytes, int] = {}
        nothing = array("q")

        def same(one, two) -> bool:
            common = len(set(one[0]).intersection(two[0])) if one[0] and two[0] else 0
            either = one[1] + two[1] - common
            if (common / either if either else 0.0) <= limit:
                return False
            if one[2] is None or two[2] is None:
                return True
            return len(one[2]) == len(two[2]) > 0 and sum(x != y for x, y in zip(one[2], two[2])) / len(one[2]) < image_below

        for page, parent, shared, size, distinct, image in zip(*(rows[c] for c in ("page_id", "parent_id", "shared", "size", "distinct", "image"))):
            lines = nothing if shared is None else array("q", [numbers.setdefault(x, len(numbers)) for x in shared])
            own = (lines, distinct, image)
            if not pd.isna(parent) and int(parent) in seen and same(own, seen[int(parent)]):
                unique[page] = unique[int(parent)]
            else:
                at = index.best(lines)
                if at is not None and same(own, seen[canon[at]]):
                    unique[page] = canon[at]
                else:
                    unique[page] = page
                    canon.append(page)
                    index.add(lines, size)
            seen[page] = own
        return pd.DataFrame({"app": rows["app"], "page_id": rows["page_id"], "unique_id": [unique[p] for p in rows["page_id"]]})

    slim = _shared(pages.select(F.col(app).alias("app"), "page_id", "parent_id", "seq", _known("lines"), "image"))
    kind = dict(slim.dtypes)
    return slim.groupBy("app").applyInPandas(place, f"app {kind['app']}, page_id {kind['page_id']}, unique_id {kind['page_id']}")


def offline(pages: DataFrame, app: str, above: float = CONTAINED_ABOVE, parity: bool = False) -> DataFrame:
    """app, page_id, unique_id: the first canonical page whose lines hold enough of the page's.

    With parity it is the last such page, as where all are compared without stopping. Pages settle in rounds of joins (containment.py),
    so an app of any size is spread over all tasks.
    """
    return canonical_of(pages, app, above, parity)[0]
