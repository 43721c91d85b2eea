"""Page-graph bookkeeping from logs: dense ids, edges, paths, frontier state, flags, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.storage import written


def first_seen_ids(log: DataFrame, key: str, seq: str) -> DataFrame:
    """key, first_seq, id: dense ids from 0 in the order in which keys first appear.

    Ranking needs one order over the distinct keys only. A range partitioning with per-partition offsets keeps
    that parallel: keys are ranked within ordered partitions and shifted by the sizes before.
    """
    firsts = log.groupBy(key).agg(F.min(seq).alias("first_seq"))
    parted = firsts.repartitionByRange("first_seq", key).withColumn("_part", F.spark_partition_id())
    local = parted.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("first_seq", key)))
    sizes = local.groupBy("_part").agg(F.max("_at").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return local.join(F.broadcast(offsets), "_part").select(key, "first_seq", (F.col("_before") + F.col("_at") - 1).cast("long").alias("id"))


def edges(log: DataFrame, who: str, node: str, seq: str) -> DataFrame:
    """src, dst: distinct steps between consecutive nodes of each walker."""
    w = Window.partitionBy(who).orderBy(seq)
    return log.select(F.lag(node).over(w).alias("src"), F.col(node).alias("dst")).filter("src is not null").distinct()


def cumulative_paths(log: DataFrame, who: str, step: str, seq: str, most: int | None = None, keep: list[str] = ()) -> DataFrame:
    """who, seq, name and the columns in keep: the path so far as segments joined by '_', one for every step or for the first `most`."""
    w = Window.partitionBy(who).orderBy(seq)
    early = log if most is None else log.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    name = F.concat_ws("_", F.concat(F.lit("app"), F.col(who).cast("string"), F.lit("0")), F.array_join(F.collect_list(step).over(upto), "_"))
    return early.select(who, seq, name.alias("name"), *keep)


def path_nodes(log: DataFrame, who: str, step: str, seq: str) -> DataFrame:
    """who, seq, node, parent, steps, first: the path after every step as a node of a trie, without its text.

    node is 128 bits of the walker and of two running sums over hashes of (place, step), so a row costs the same however
    long its walk is; equal paths of a walker have one node. parent is the node of the step before, null at the first; steps counts the
    segments after the walker's own; first is the first step.
    """
    w = Window.partitionBy(who).orderBy(seq)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = log.select(who, seq, F.col(step).alias("_step"), F.row_number().over(w).alias("_k"))
    hashed = lambda salt: F.sum(F.xxhash64(F.lit(salt), "_k", "_step").cast("decimal(20,0)")).over(upto).cast("string")
    node = F.md5(F.concat_ws("|", F.col(who).cast("string"), F.col("_k").cast("string"), hashed("one"), hashed("two")).cast("binary"))
    steps = F.sum(F.size(F.split("_step", "_")).cast("long")).over(upto)
    named = placed.select(who, seq, node.alias("node"), steps.alias("steps"), F.first("_step").over(upto).alias("first"))
    return named.withColumn("parent", F.lag("node").over(w)).select(who, seq, "node", "parent", "steps", "first")


def held_by_ancestor(nodes: DataFrame, holds: DataFrame) -> DataFrame:
    """nodes(node, parent, depth, page_id) with hold: some hold(node, since) is the node or above it, from its page on.

    The least `since` above each node comes by pointer doubling: every round a node takes over what the node it points to
    has found and points to where that one pointed, so the rounds are the logarithm of the depth and a row stays of one size.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    earliest = holds.groupBy("node").agg(F.min("since").alias("since"))
    now = written(nodes.join(earliest, "node", "left").select("node", F.col("parent").alias("up"), "since"), "doubling")
    for _ in range(int(deepest).bit_length()):
        above = now.select(F.col("node").alias("up"), F.col("since").alias("_since"), F.col("up").alias("_up"))
        now = written(now.join(above, "up", "left").select("node", F.col("_up").alias("up"), F.least("since", "_since").alias("since")), "doubling")
    found = nodes.join(now.select("node", "since"), "node")
    return found.withColumn("hold", F.coalesce(F.col("page_id") >= F.col("since"), F.lit(False))).drop("since")


def held_on_walks(log: DataFrame, who: str, seq: str, holds: Column) -> DataFrame:
    """log with hold: the step itself or one before it of the same walk holds.

    What held_by_ancestor() finds where every path is a walk's own, so that the paths above a step are those of the steps
    before it: one running flag over the order that the paths take anyway, without a round of joins.
    """
    upto = Window.partitionBy(who).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("hold", F.coalesce(F.max(holds).over(upto), F.lit(False)))


def segments(name: Column) -> Column:
    return F.split(name, "_")


def parent_name(name: Column) -> Column:
    """The path without its last segment; null for a first segment."""
    s = segments(name)
    return F.when(F.size(s) > 1, F.array_join(F.slice(s, 1, F.size(s) - 1), "_"))


def prefixes(name: Column) -> Column:
    """All paths from the first segment down to the path itself."""
    s = segments(name)
    return F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, 1, i), "_"))


def folder(name: Column) -> Column:
    """Folder of a page in the level layout: all segments but the last, joined by '/'."""
    s = segments(name)
    return F.array_join(F.slice(s, 1, F.size(s) - 1), "/")


def fan_out(edges_: DataFrame, above: int = 3) -> DataFrame:
    """src, children of the nodes with more than `above` distinct successors."""
    return edges_.groupBy("src").agg(F.countDistinct("dst").alias("children")).filter(F.col("children") > above)


def edge_union(edges_: DataFrame) -> DataFrame:
    """src, dsts (distinct, ordered), n."""
    return edges_.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("dsts")).withColumn("n", F.size("dsts"))


def last_flags(events: DataFrame, key: str, seq: str, flag: str) -> DataFrame:
    """key, flag: the last flag of each key wins."""
    return events.groupBy(key).agg(F.max_by(flag, F.struct(seq)).alias(flag))


def held_by_prefix(pages: DataFrame, holds: DataFrame) -> DataFrame:
    """pages(page_id, name) with hold: some hold(prefix, since) starts the name, from its page on.

    The theta join on startsWith is an equi-join: each name is matched by its own prefixes, which
    are as many as its segments.
    """
    own = pages.select("page_id", F.explode(prefixes(F.col("name"))).alias("prefix"))
    hit = own.join(holds, "prefix").filter(F.col("page_id") >= F.col("since")).select("page_id").distinct().withColumn("hold", F.lit(True))
    return pages.join(hit, "page_id", "left").withColumn("hold", F.coalesce("hold", F.lit(False)))


def eligible(frontier: DataFrame, most: int, begins: list[str] = (), never: list[str] = ()) -> DataFrame:
    """Frontier rows (name, unique_name, done, hold) that may be visited next.

    begins: the name must start with one of these; never: segments it must not hold, which are looked
    at only where begins are given.
    """
    name = F.col("name")
    ok = (F.size(segments(name)) <= most) & (name == F.col("unique_name")) & ~F.col("done") & ~F.col("hold")
    if begins:
        any_of = F.lit(False)
        for p in begins:
            any_of = any_of | name.startswith(p)
        ok = ok & any_of
        for s in never:
            ok = ok & ~(name.contains(f"_{s}_") | name.endswith(f"_{s}"))
    return frontier.filter(ok)


def write_shards(frontier: DataFrame, path: str, by: str) -> None:
    """Writes the rows of the shards that frontier has; other shards of the table at path stay as they are."""
    frontier.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_shards(spark: SparkSession, path: str, by: str, shards: list) -> DataFrame:
    """A worker's part of a frontier: only the folders of its shards are listed and read."""
    return spark.read.parquet(path).filter(F.col(by).isin(shards))


def round_robin(frontier: DataFrame, start: int, n: int, groups: str) -> DataFrame:
    """The next row of each group, counting from start and around n."""
    order = Window.partitionBy(groups).orderBy(F.pmod(F.col("name_id") - F.lit(start), F.lit(n)), "name_id")
    return frontier.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def next_pages(frontier: DataFrame, starts: DataFrame, n: int, seed: str, shallow: int = 3) -> DataFrame:
    """start, name_id: the row that comes next from each of a few starts(start); frontier(name_id, depth, ok).

    A row that may be visited is its own next one. From another, the search begins at the following row where it is no
    deeper than `shallow`, else at a row chosen by hash, and takes the first that may be visited, around n.
    """
    here = F.broadcast(starts.withColumnRenamed("start", "name_id"))
    chance = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("name_id").cast("string"))), 1, 8), 16, 10).cast("long") % n
    begin = F.when(F.col("ok"), F.col("name_id")).when(F.col("depth") <= shallow, (F.col("name_id") + 1) % n).otherwise(chance)
    begins = frontier.join(here, "name_id").select(F.col("name_id").alias("start"), begin.alias("begin"))
    # Per start one row of the frontier survives each partition, so what is shuffled is starts times partitions.
    near = F.struct(F.pmod(F.col("name_id") - F.col("begin"), F.lit(n)).alias("d"), "name_id")
    found = frontier.filter("ok").select("name_id").crossJoin(F.broadcast(begins)).groupBy("start").agg(F.min(near).alias("b"))
    return found.select("start", F.col("b.name_id").alias("name_id"))


def integrity(ids: DataFrame) -> DataFrame:
    """violations: ids (id) that are not 0 .. n-1, each once."""
    return ids.agg((F.count("*") - F.countDistinct("id") + F.coalesce(F.sum(F.when((F.col("id") < 0), 1)), F.lit(0)) + F.abs(F.coalesce(F.max("id") + 1, F.lit(0)) - F.count("*"))).cast("long").alias("violations"))


def actions_from_names(pages: DataFrame) -> DataFrame:
    """name, actions: children's last segments, rebuilt from page names alone."""
    s = segments(F.col("name"))
    kids = pages.filter(F.size(s) > 1).select(parent_name(F.col("name")).alias("name"), F.element_at(s, -1).alias("action"))
    return kids.groupBy("name").agg(F.sort_array(F.collect_set("action")).alias("actions")).join(pages.select("name").distinct(), "name", "left_semi")


def next_free_index(names: DataFrame, pattern: str) -> DataFrame:
    """next_index: one above the highest number that pattern finds in name, 0 where it finds none."""
    n = F.nullif(F.regexp_extract("name", pattern, 1), F.lit("")).cast("long")
    return names.agg((F.coalesce(F.max(n), F.lit(-1)) + 1).alias("next_index"))


def last_name(names: DataFrame, pattern: str) -> DataFrame:
    """name: the one with the highest number that pattern finds, the first by name on ties; no row where it finds none."""
    n = F.nullif(F.regexp_extract("name", pattern, 1), F.lit("")).cast("long")
    best = names.select("name", n.alias("n")).filter("n is not null").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("b"))
    return best.filter("b is not null").select("b.name")


def by_suffix(names: DataFrame) -> DataFrame:
    """name, place: the place from 0 of each distinct name in the order of its last segment followed by the name."""
    key = F.concat(F.element_at(segments(F.col("name")), -1), "name")
    return first_seen_ids(names.withColumn("_key", key), "name", "_key").select("name", F.col("id").alias("place"))


def named_actions(log: DataFrame, ids: DataFrame, id_: str, name: str) -> DataFrame:
    """log with the action's name for its id; null where the id is unknown, the first name where several have it."""
    return log.join(ids.groupBy(id_).agg(F.min(name).alias(name)), id_, "left")


def best_per_group(rows: DataFrame, group: str, value: str, seq: str) -> DataFrame:
    """The row with the highest value of each group, the later on ties."""
    order = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(seq).desc())
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def chunk_of(zero_based: Column, total: Column, parts: int) -> Column:
    """Contiguous parts of equal size, the last with the remainder; with fewer rows than parts all are in the last."""
    size = F.floor(total / parts)
    return F.when(size == 0, F.lit(parts - 1)).otherwise(F.least(F.floor(zero_based / F.greatest(size, F.lit(1))), F.lit(parts - 1))).cast("int")


def hash_order(seed: str, *keys: str) -> Column:
    """A reproducible random order: the md5 of seed and keys, the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
