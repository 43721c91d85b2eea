"""Streaming upkeep of the page tables from a log of crawl events."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def visits(log: DataFrame, who: str = "user_id", node: str = "event_type", ts: str = "ts") -> DataFrame:
    """Per walker and node: visits, first and last time. The state is one row per key, combined map-side."""
    return log.groupBy(who, node).agg(F.count("*").alias("visits"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def windowed_counts(log: DataFrame, node: str = "event_type", ts: str = "ts", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Visits per node and time window; a window's state goes once the watermark has passed it."""
    return log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), node).agg(F.count("*").alias("visits")).select("window.start", "window.end", node, "visits")


def run_once(source: DataFrame, path: str, table: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming result over what is there now, written as Parquet below path by the executors, and returns it."""
    spark: SparkSession = source.sparkSession
    at = f"{path}/{table}"
    kept = "overwrite" if mode == "complete" else "append"
    query: StreamingQuery = (
        source.writeStream.foreachBatch(lambda batch, _: batch.write.mode(kept).parquet(at)).outputMode(mode)
        .option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(at)


def upkeep(source: DataFrame, path: str, batches: Callable[[str], Callable[[DataFrame, int], None]]) -> dict[str, DataFrame]:
    """Runs a stream over what is there now, each batch merged into tables below path, and returns the tables by name."""
    spark: SparkSession = source.sparkSession
    query: StreamingQuery = (
        source.writeStream.foreachBatch(batches(path)).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return {name: table for name in TABLES if (table := latest(spark, f"{path}/{name}")) is not None}


#: The tables that a crawl's log keeps up.
TABLES = ("visits", "pages", "edges", "frontier", "canonical", "walkers")
#: Runs of one level that are merged into one of the next.
FAN = 4


def _merged(merge: dict[str, str]) -> list[Column]:
    """Aggregates by name: sum, min, max, or last:<column>, the value where that column is highest."""
    out = []
    for name, how in merge.items():
        kind, _, order = how.partition(":")
        out.append((F.max_by(name, order) if kind == "last" else getattr(F, kind)(name)).alias(name))
    return out


def _fs(spark: SparkSession, path: str):
    """A folder as the cluster's file system knows it, and that file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The batches whose manifest is there, ascending; old ones are removed, so they are few."""
    root, fs = _fs(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(_fs(spark, f"{path}/manifest/{n}/_SUCCESS")[0]))


def _manifest(spark: SparkSession, path: str, below: int | None = None) -> dict | None:
    """keys, merge and runs (name, level) of an upserted table as its last batch left it, or the last one below a batch."""
    done = [b for b in _batches(spark, path) if below is None or b < below]
    return json.loads(spark.read.text(f"{path}/manifest/batch={done[-1]}").first()[0]) if done else None


def _merged_runs(spark: SparkSession, path: str, known: dict, runs: list[str]) -> DataFrame:
    rows = spark.read.parquet(*[f"{path}/data/{r}" for r in runs])
    return rows.groupBy(*known["keys"]).agg(*_merged(known["merge"]))


def latest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """An upserted table as its last whole batch left it, or the last one below a batch."""
    known = _manifest(spark, path, below)
    return _merged_runs(spark, path, known, [name for name, _ in known["runs"]]) if known else None


def merge_rows(path: str, batch_id: int, rows: DataFrame, keys: list[str], merge: dict[str, str]) -> None:
    """Merges rows into the table at path: old and new rows of a key are aggregated as `merge` says.

    A batch writes a run of its own keys only. FAN runs of a level become one of the next, so a row is written anew as often as
    the logarithm of the table's size, and a reader merges FAN runs a level at most. The manifest is written last: a reader
    or a restarted query sees whole batches only, and a batch that runs again writes the same. Runs that neither this
    manifest nor the one before names are deleted.
    """
    spark = rows.sparkSession
    before = _manifest(spark, path, below=batch_id)
    known = {"keys": keys, "merge": merge, "runs": [tuple(r) for r in before["runs"]] if before else []}
    rows.groupBy(*keys).agg(*_merged(merge)).write.mode("overwrite").parquet(f"{path}/data/batch-{batch_id}-0")
    known["runs"].append((f"batch-{batch_id}-0", 0))
    level = 0
    while len(full := [name for name, at in known["runs"] if at == level]) >= FAN:
        name = f"batch-{batch_id}-{level + 1}"
        _merged_runs(spark, path, known, full).write.mode("overwrite").parquet(f"{path}/data/{name}")
        known["runs"] = [r for r in known["runs"] if r[0] not in full] + [(name, level + 1)]
        level += 1
    spark.range(1).select(F.lit(json.dumps(known)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/manifest/batch={batch_id}")
    _vacuum(spark, path, batch_id, {r[0] for r in known["runs"]} | {r[0] for r in (before["runs"] if before else [])})


def _vacuum(spark: SparkSession, path: str, batch_id: int, needed: set[str]) -> None:
    """Removes the runs that are not needed, and the manifests before the last two up to a batch."""
    root, fs = _fs(spark, f"{path}/data")
    for name in [s.getPath().getName() for s in fs.listStatus(root)]:
        if name not in needed:
            fs.delete(_fs(spark, f"{path}/data/{name}")[0], True)
    for b in [b for b in _batches(spark, path) if b < batch_id][:-1]:
        fs.delete(_fs(spark, f"{path}/manifest/batch={b}")[0], True)


def visits_of_batches(path: str, who: str = "user_id", node: str = "event_type", ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """A batch function that keeps up the table of visits()."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_rows(f"{path}/visits", batch_id, visits(batch, who, node, ts), [who, node], {"visits": "sum", "first_ts": "min", "last_ts": "max"})

    return merge


def walks_of_batches(path: str, who: str = "user_id", node: str = "event_type", seq: str = "event_id", flag: str = "value") -> Callable[[DataFrame, int], None]:
    """A batch function that keeps up what a crawl's log says.

    pages (who, node, page_id: the first sequence number), edges (src, dst, steps, first_seq), frontier (who, node,
    last_seq, flag: the last one wins), canonical (node, unique_id: the first page anywhere) and walkers (who, last_seq, node),
    from which the first step of the next batch goes on. Edges need batches in order of seq for each walker; steps.py keeps them up
    without.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = batch.select(who, F.col(node).alias("node"), F.col(seq).alias("seq"), F.col(flag).alias("flag")).persist()
        merge_rows(f"{path}/pages", batch_id, log.groupBy(who, "node").agg(F.min("seq").alias("page_id")), [who, "node"], {"page_id": "min"})
        merge_rows(f"{path}/canonical", batch_id, log.groupBy("node").agg(F.min("seq").alias("unique_id")), ["node"], {"unique_id": "min"})
        last = log.groupBy(who, "node").agg(F.max("seq").alias("last_seq"), F.max_by("flag", "seq").alias("flag"))
        merge_rows(f"{path}/frontier", batch_id, last, [who, "node"], {"last_seq": "max", "flag": "last:last_seq"})
        walkers = latest(spark, f"{path}/walkers", below=batch_id)
        steps = log.select(who, "node", "seq", F.lit(True).alias("new"))
        if walkers is not None:
            steps = steps.unionByName(walkers.select(who, "node", F.col("last_seq").alias("seq"), F.lit(False).alias("new")))
        before = F.lag("node").over(Window.partitionBy(who).orderBy("seq"))
        made = steps.withColumn("src", before).filter("new and src is not null")
        edges = made.groupBy("src", F.col("node").alias("dst")).agg(F.count("*").alias("steps"), F.min("seq").alias("first_seq"))
        merge_rows(f"{path}/edges", batch_id, edges, ["src", "dst"], {"steps": "sum", "first_seq": "min"})
        ends = log.groupBy(who).agg(F.max("seq").alias("last_seq"), F.max_by("node", "seq").alias("node"))
        merge_rows(f"{path}/walkers", batch_id, ends, [who], {"last_seq": "max", "node": "last:last_seq"})
        log.unpersist()

    return merge


def upsert_to(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A batch function for foreachBatch: the newest row of each key, merged with the table at path (see merge_rows)."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        others = [c for c in batch.columns if c not in keys and c != order]
        merge_rows(path, batch_id, batch, keys, {c: f"last:{order}" for c in others} | {order: "max"})

    return merge
