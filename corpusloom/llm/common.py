"""What the training-data operators share: shared-folder stashes, word patterns, checked broadcasts."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.storage import shared_dir, small_batches  # noqa: F401

#: The white space of every contract here: space, tab, newline, vertical tab, form feed, return.
WS = "\\x20\\x09-\\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"

#: A side of a join is broadcast only when it has been counted and holds at most so many rows.
BROADCAST_ROWS = 20_000

#: Keys that hold more than a FREQUENT-th of all rows are joined by broadcast; there are no more than FREQUENT of them.
FREQUENT = 1000

#: So few rows are no burden to one task, whatever their keys: joins of no more are not split.
FEW = 10_000

_stashes: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    Lineage ends there, so a lost executor costs only the tasks it ran, and what follows
    reads columns it needs from files that every executor sees. Removed by release_stashes().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stashes.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of work that is over: it does so once the driver's JVM collects the plans that made them.

    By itself that happens when the driver's heap fills up or every spark.cleaner.periodicGC.interval (half an hour); between
    large steps whose results are stashed it keeps the executors' disks free.
    """
    spark.sparkContext._jvm.System.gc()


def stashes_made() -> int:
    """How many stashes there are now, for release_stashes()."""
    return len(_stashes)


def release_stashes(first: int = 0, last: int | None = None) -> None:
    """Deletes the stashes made from first to before last, or all; call it when the results that rest on them have been written."""
    gone = _stashes[first:last]
    del _stashes[first:last]
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended: its folder goes with the cluster's own clean-up
            pass


atexit.register(release_stashes)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table out again whose files make fewer tasks than there are cores; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(base: str, columns: list[str]) -> str:
    """A column name that is not taken, whatever the case of those that are."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, under which no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def squeezed(text: Column) -> Column:
    """text without its white space, by byte-wise replacements inside generated code."""
    for ch in WS_CHARS:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def fold_of(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


def frequent_from(rows: int) -> int:
    """From how many rows on a key is frequent; so many rows have FREQUENT such keys at most."""
    return max(1, -(-rows // FREQUENT))


def split_join(rows: DataFrame, keyed: DataFrame, on: list[str], least: int) -> DataFrame:
    """rows joined to keyed, which has one row per key and, as times, the number of rows that have the key.

    Keys of `least` rows or more (see frequent_from) are broadcast and their rows stay where they are; the others
    are joined by shuffling, and none of them is large.
    """
    hot = keyed.filter(F.col("times") >= least)
    if hot.isEmpty():
        return rows.join(keyed.drop("times"), on)
    settled = rows.join(F.broadcast(hot.drop("times")), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return settled.unionByName(rest.join(keyed.filter(F.col("times") < least).drop("times"), on))


def copied_join(counted: DataFrame, rows: DataFrame, keyed: DataFrame, on: str) -> DataFrame:
    """rows joined to keyed, which has one row per key and may have wide ones; counted has the keys of rows.

    The row of a key that a FREQUENT-th of all rows or more have is copied as often as it exceeds that, and the rows are
    dealt out among the copies: FREQUENT keys at most, and twice as many copies.
    """
    n = counted.count()
    if n <= FEW:
        return rows.join(keyed, on)
    least = frequent_from(n)
    hot = counted.groupBy(on).count().filter(F.col("count") >= least).select(on, F.ceil(F.col("count") / least).cast("int").alias("_parts"))
    hot = stash(hot, "hot")
    if hot.isEmpty():
        return rows.join(keyed, on)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_parts")
    copies = keyed.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [on, "_part"]).drop("_part")


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int, salts: int = 16) -> DataFrame:
    """Joins a table of a counted size: broadcast within BROADCAST_ROWS, else by salted keys.

    The salted way copies each row of small `salts` times and deals the rows of big out by
    key and salt, so that a key with a third of all rows does not meet in one task.
    """
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
