"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each document gets a fixed 60-bit hash. A source that must give q whole passes and a remainder R
takes every document q times, and once more those whose hash lies under the source's threshold.
The threshold is found from sums by source and hash bucket: the first 12 bits of the hash give
4096 buckets, the bucket where the running sum crosses R is refined by the next 12 bits, and so on
five levels deep. No level holds more than 4096 rows a source, and documents are never sorted.
At the last level the crossing hash is taken or left, whichever comes nearer to R, so a source
misses its target by at most half of one document.

Targets: weights 5, 2, 1 repeat over the sources by code point, null last. The budget (1.5 times
all sizes) is shared by weight; a target stops at twice its source's size and the excess is shared
again until none is above, which is the water level computed here in closed form.

Cases: null text has size 0 and is taken 0 times; a null source is a source of its own; a null
doc_id is hashed by its text; rows with equal hashes (repeated rows) are taken alike; an empty
table gives an empty result; a corpus without words gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WS, small_join, stash, text_or_empty, whole_row

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, CAP = 1.5, 2.0
BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    """Number of runs without white space: each run, with the space around it, shrinks to one mark."""
    marks = F.regexp_replace(text, f"[{WS}]*+[^{WS}]++[{WS}]*+", "x")
    return F.when(text.rlike(f"[^{WS}]"), F.length(marks)).otherwise(0).cast("long")


def _slim(docs: DataFrame, *more: Column) -> DataFrame:
    text = text_or_empty()
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text))
    return docs.select(
        "doc_id",
        "source",
        word_count(text).alias("size"),
        F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("h"),
        *more,
    )


def _keyed(slim: DataFrame) -> DataFrame:
    """A key that tells a null source from any other."""
    return slim.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size)."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * CAP)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    steps = (
        weighed.withColumn("total", F.sum("source_size").over(everything) * BUDGET)
        .withColumn("full_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level_here", (F.col("total") - F.col("full_before")) / F.col("w_left"))
        # The water level is that of the first source, by cap per weight, which it does not fill;
        # later sources would compute a lower one.
        .withColumn("level", F.max(F.when(F.col("level_here") * F.col("w") <= F.col("cap"), F.col("level_here"))).over(everything))
    )
    share = F.coalesce(F.col("level") * F.col("w"), F.col("cap"))
    return steps.select("source", "source_size", F.least("cap", share).alias("target"))


def _prefix(level: int) -> Column:
    """The hash's first level * BITS bits."""
    return F.shiftright(F.col("h"), BITS * (LEVELS - level))


def thresholds(slim: DataFrame) -> tuple[DataFrame, int]:
    """key, source_size, target, passes, limit: one row per source, and their number."""
    base = slim
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stash(
        targets(sizes)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .transform(_keyed),
        "targets",
    )
    n = goal.count()
    keyed = _keyed(base)
    # The bound: every hash under it is within the remainder; at first, none is.
    edge = goal.select("key", F.col("rest"), F.lit(0).cast("long").alias("bound"), F.lit(0).cast("long").alias("below"))
    run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(1, LEVELS + 1):
        at = edge.withColumnRenamed("bound", "parent")
        inside = keyed if level == 1 else small_join(keyed, at.select("key", "parent"), ["key"], "inner", n).filter(_prefix(level - 1) == F.col("parent"))
        histogram = inside.groupBy("key", _prefix(level).alias("bucket")).agg(F.sum("size").alias("mass"))
        summed = histogram.withColumn("upto", F.sum("mass").over(run))
        crossing = small_join(summed, at, ["key"], "inner", n).filter(F.col("below") + F.col("upto") > F.col("rest"))
        first = crossing.groupBy("key").agg(F.expr("min_by(struct(bucket, upto, mass), bucket)").alias("c"))
        edge = (
            at.join(first, "key", "left")
            .select(
                "key",
                "rest",
                F.when(F.col("rest") > 0, F.col("c.bucket")).alias("bound"),
                (F.col("below") + F.coalesce(F.col("c.upto") - F.col("c.mass"), F.lit(0))).alias("below"),
                F.col("c.mass").alias("mass"),
            )
        )
        edge = stash(edge, f"edge{level}")
        if level < LEVELS:
            edge = edge.drop("mass")
    # The crossing hash itself goes in if that comes nearer to the remainder.
    nearer = (F.col("below") + F.col("mass") - F.col("rest")) <= (F.col("rest") - F.col("below"))
    limit = edge.select("key", F.when(F.col("bound").isNull(), -1).otherwise(F.col("bound") + nearer.cast("long")).alias("limit"))
    final = goal.join(limit, "key").select("key", "source_size", "target", "passes", "limit")
    return stash(final, "thresholds"), n


def _with_copies(keyed: DataFrame, final: DataFrame, n: int) -> DataFrame:
    extra = F.when(F.col("h") < F.col("limit"), 1).otherwise(0)
    return small_join(keyed, final, ["key"], "inner", n).withColumn("copies", F.col("passes") + extra)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    slim = stash(_slim(docs), "sizes")
    final, n = thresholds(slim)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return _with_copies(_keyed(slim), final, n).select("doc_id", "size", "source_size", "target", taken)


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, columns unchanged; texts are not shuffled."""
    final, n = thresholds(stash(_slim(docs), "sizes"))
    keyed = _keyed(_slim(docs, whole_row(docs).alias("doc"))).select("key", "h", "doc")
    return _with_copies(keyed, final, n).filter("copies > 0").select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")
