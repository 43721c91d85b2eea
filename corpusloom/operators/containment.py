"""Which page's lines are held by an earlier page's, and which pages stand for others, without an ordered pass.

A page is held by another where more than `above` of its lines, counted as often as they occur, are among the other's.
Pages of one app with equal lines are one class, whose first page speaks for it. Classes meet by a prefix filter on
the contained side only: its rarest lines, as many as cannot all be missing. The containing side is indexed by all its
lines; a line that HOT classes or more have is split by the container's size, as a small page cannot hold a large one.

A page is canonical where no earlier canonical page of its app holds it. That is the lexicographically first maximal
independent set of the graph of held pages, and it settles in rounds: what a canonical page holds is settled at once, and
a page is canonical as soon as none of the earlier pages that hold it is left. The rounds are as many as the longest
chain of undecided pages, not as the pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.storage import written

#: Lines that so many classes of an app have are split by size.
HOT = 1000
#: Rounds after which settling gives up: the longest chain of pages that wait for each other.
ROUNDS = 10_000


def classes(pages: DataFrame, app: str) -> DataFrame:
    """app, page_id, seq, lines, cls of every page: cls is the struct (seq, page_id) of the first page with equal lines.

    app is wrapped in a struct, in which null equals null. Lines are known to the rest by 128-bit digests. A page without
    lines is a class of its own.
    """
    known = F.filter(F.coalesce("lines", F.array().cast("array<string>")), lambda x: x.isNotNull())
    digests = F.array_sort(F.transform(known, lambda x: F.md5(x.cast("binary"))))
    rows = pages.select(F.struct(F.col(app).alias("name")).alias("app"), "page_id", "seq", digests.alias("lines"))
    rows = written(rows.withColumn("same", F.when(F.size("lines") > 0, F.md5(F.array_join("lines", "").cast("binary")))), "pages")
    first = rows.filter("same is not null").groupBy("app", "same").agg(F.min(F.struct("seq", "page_id")).alias("first"))
    named = rows.join(first, ["app", "same"], "left").withColumn("cls", F.coalesce("first", F.struct("seq", "page_id")))
    return named.select("app", "page_id", "seq", "lines", "cls")


def held_by(members: DataFrame, above: float, ordered: bool = True) -> DataFrame:
    """app, a, b: class a is held by class b, and the first page of b comes before that of a if ordered. members as from classes()."""
    reps = written(members.filter((F.col("cls") == F.struct("seq", "page_id")) & (F.size("lines") > 0)).select("app", "cls", "lines"), "classes")
    each = reps.select("app", "cls", F.size("lines").alias("total"), F.explode("lines").alias("line"))
    counted = written(each.groupBy("app", "cls", "line").agg(F.count("*").alias("n"), F.first("total").alias("total")), "lines")
    often = counted.groupBy("app", "line").agg(F.count("*").alias("classes")).filter("classes > 1")  # a line of one class leads to no other
    rows = counted.join(often, ["app", "line"], "left").withColumn("classes", F.coalesce("classes", F.lit(1)))

    own = Window.partitionBy("app", "cls")
    before = F.coalesce(F.sum("n").over(own.orderBy("classes", "line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("n").over(own.orderBy(F.desc("n"), "line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("before", before).withColumn("upto", upto)
    # A container has so many distinct lines of the page at least.
    rows = rows.withColumn("need", 1 + F.count(F.when(F.col("upto") / F.col("total") <= above, 1)).over(own)).withColumn("distinct", F.count("*").over(own))
    rows = written(rows.filter("classes > 1").select("app", "cls", "line", "total", "before", "classes", "need", "distinct"), "met")
    step = lambda c: F.floor(F.log2(F.col(c).cast("double"))).cast("int")
    hot = F.col("classes") >= HOT
    index = rows.select("app", "line", F.col("cls").alias("b"), F.when(hot, step("distinct")).otherwise(-1).alias("part"))
    largest = rows.agg(F.max(step("distinct"))).first()[0] or 0
    parts = F.when(hot, F.sequence(step("need"), F.greatest(step("need"), F.lit(largest)))).otherwise(F.array(F.lit(-1)))
    # A line is in the prefix as long as all lines before it could be missing.
    prefix = rows.filter((F.col("total") - F.col("before")) / F.col("total") > above)
    asking = prefix.select("app", "line", F.col("cls").alias("a"), F.explode(parts).alias("part"))
    pairs = asking.join(index, ["app", "line", "part"]).filter("b < a" if ordered else "b <> a").select("app", "a", "b").distinct()

    # Confirmed on the whole lines: distinct ones in common, and the further times of those that occur more than once.
    entry = F.struct("line", (F.col("n") - 1).alias("more"))
    repeated = counted.filter("n > 1").groupBy("app", F.col("cls").alias("a")).agg(F.map_from_entries(F.collect_list(entry)).alias("more"))
    one = reps.select("app", F.col("cls").alias("a"), F.array_distinct("lines").alias("x"), F.size("lines").alias("total")).join(repeated, ["app", "a"], "left")
    other = reps.select("app", F.col("cls").alias("b"), F.array_distinct("lines").alias("y"))
    both = pairs.join(one, ["app", "a"]).join(other, ["app", "b"]).withColumn("common", F.array_intersect("x", "y"))
    further = F.aggregate("common", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.try_element_at("more", x), F.lit(0).cast("long")))
    hits = F.size("common") + F.coalesce(further, F.lit(0))
    return both.filter(hits / F.col("total") > above).select("app", "a", "b")


def first_independent(edges: DataFrame) -> tuple[DataFrame, int]:
    """app, b: those of the holding classes that are canonical, and the rounds it took. edges: app, a, b (a is held by the earlier b)."""
    left, canonical = edges, None
    held = edges.select("app", F.col("a").alias("b")).distinct()
    new = written(edges.select("app", "b").distinct().join(held, ["app", "b"], "left_anti"), "canonical")
    for rounds in range(1, ROUNDS):
        canonical = new if canonical is None else canonical.unionByName(new)
        if rounds % 20 == 0:
            canonical = written(canonical, "canonical")
        settled = written(left.join(new, ["app", "b"], "left_semi").select("app", "a").distinct(), "settled")
        undecided = left.join(settled, ["app", "a"], "left_anti")
        waiting = undecided.select("app", "a").distinct()
        left = written(undecided.join(settled.withColumnRenamed("a", "b"), ["app", "b"], "left_anti").select("app", "a", "b"), "left")
        new = written(waiting.join(left.select("app", "a").distinct(), ["app", "a"], "left_anti").select("app", F.col("a").alias("b")), "canonical")
        if new.isEmpty():
            return canonical, rounds
    raise RuntimeError(f"pages did not settle in {ROUNDS} rounds")


def canonical_of(pages: DataFrame, app: str, above: float, last: bool = False) -> tuple[DataFrame, int]:
    """(app, page_id, unique_id), and the rounds: the first canonical page that holds the page's lines, or with `last` the last one before it.

    pages(app, page_id, seq, lines) in the order of seq and page_id, which are known and, together, unique in an app. Null
    lines are none; a page without lines is held by none and holds none; a null app is an app.
    """
    members = written(classes(pages, app), "members")
    pairs = written(held_by(members, above, ordered=not last), "pairs")
    edges = pairs.filter("b < a")
    canonical, rounds = first_independent(edges)
    settled = written(edges.join(canonical, ["app", "b"], "left_semi").select("app", F.col("a").alias("cls")).distinct(), "settled")
    real = pairs.join(settled.withColumnRenamed("cls", "b"), ["app", "b"], "left_anti").withColumnRenamed("a", "cls")
    rows = members.select("app", "page_id", "cls", F.struct("seq", "page_id").alias("page"))
    if last:
        # A copy may also be held by its class's first page, and by canonical pages between the two.
        own = rows.filter("page > cls").join(settled, ["app", "cls"], "left_anti").select("app", "page", F.col("cls").alias("b"))
        before = rows.join(real, ["app", "cls"]).filter("b < page").select("app", "page", "b").unionByName(own)
        found = rows.join(before.groupBy("app", "page").agg(F.max("b").alias("by")), ["app", "page"], "left").withColumn("by", F.coalesce("by", "page"))
    else:
        first = real.groupBy("app", "cls").agg(F.min("b").alias("by"))
        found = rows.join(first, ["app", "cls"], "left").withColumn("by", F.coalesce("by", "cls"))
    return found.select(F.col("app.name").alias("app"), "page_id", F.col("by.page_id").alias("unique_id")), rounds
