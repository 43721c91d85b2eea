"""Exact dedup by a heavy-hitter split, in DataFrame operations only.

Digests of the squeezed texts (no white space) are summarised by one Misra-Gries style pass:
`approx_top_k` keeps a bounded table of counters per task and merges them. Its candidates are
counted exactly; the winners (frequent digests with the row that stays) are broadcast, at most
`heavy_slots` rows, and settle their groups map-side without a shuffle. What remains has no
digest with more than about rows / heavy_slots copies and is settled by an ordinary aggregation
and join on the digest.

Cases: null text counts as empty; all-blank texts form one group; a null doc_id sorts last, so it
stays only if no row of equal length has an id; of rows that are equal in every respect exactly one
is kept; an empty table gives an empty result; columns other than doc_id and text pass untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import squeezed, stash, text_or_empty, whole_row

#: Candidates that are verified, and counters that each sketch may hold.
HEAVY_SLOTS, COUNTERS = 1024, 8192


def _digests(docs: DataFrame) -> DataFrame:
    """One slim row per document; row tells equal rows apart and is fixed by the stash."""
    text = text_or_empty()
    return docs.select(
        "doc_id",
        F.sha2(squeezed(text), 256).alias("digest"),
        F.length(text).cast("long").alias("n_cp"),
        F.monotonically_increasing_id().alias("row"),
    )


#: Order of preference within a group: most code points, then smallest doc_id, null last.
_BEST = "min(struct(-n_cp as a, doc_id is null as b, doc_id as doc_id, row as row)) as best"


def _settle(docs: DataFrame, heavy_slots: int, counters: int) -> tuple[DataFrame, DataFrame]:
    """The settled rows (doc_id, digest, n_cp, row, group_size, keep_id, keep_row), and the heavy winners."""
    base = stash(_digests(docs), "digests")
    top = base.agg(F.expr(f"approx_top_k(digest, {heavy_slots}, {counters})").alias("top"), F.count("*").alias("n"))
    candidates = top.select(F.explode("top.item").alias("digest"), "n")  # heavy_slots rows at most
    winners = stash(
        base.join(F.broadcast(candidates), "digest")
        .groupBy("digest", "n")
        .agg(F.count("*").alias("group_size"), F.expr(_BEST))
        .filter((F.col("group_size") >= 2) & (F.col("group_size") * 2 * heavy_slots >= F.col("n")))
        .select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")),
        "heavy",
    )
    heavy = base.join(F.broadcast(winners), "digest")
    rest = base.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = (
        rest.groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.expr(_BEST))
        .select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    )
    return heavy.unionByName(rest.join(light, "digest")), winners


def decisions(docs: DataFrame, heavy_slots: int = HEAVY_SLOTS, counters: int = COUNTERS) -> DataFrame:
    """doc_id, digest, n_cp, group_size, keep_id, kept: one row per input row."""
    settled, _ = _settle(docs, heavy_slots, counters)
    return settled.withColumn("kept", F.col("row") == F.col("keep_row")).drop("row", "keep_row")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, for every document, dropped ones too."""
    return decisions(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, heavy_slots: int = HEAVY_SLOTS, counters: int = COUNTERS) -> DataFrame:
    """docs without their exact copies, columns unchanged.

    Rows of heavy digests leave map-side; the rest meet the slim table of keepers once, by digest.
    """
    settled, winners = _settle(docs, heavy_slots, counters)
    keepers = stash(
        settled.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"))
        .agg(F.count("*").alias("_rows")),
        "keepers",
    )
    heavy = winners.select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_heavy"), F.lit(True).alias("_hot"))
    tagged = (
        docs.select(whole_row(docs).alias("doc"), F.sha2(squeezed(text_or_empty()), 256).alias("_digest"))
        .join(F.broadcast(heavy), "_digest", "left")
        .filter(F.col("_hot").isNull() | F.col("doc.doc_id").eqNullSafe(F.col("_heavy")))
    )
    same = F.expr("coalesce(doc.doc_id = _keep, doc.doc_id is null and _keep is null)")
    met = tagged.join(keepers.hint("shuffle_hash"), "_digest").filter(same)
    if not keepers.filter("_rows > 1").isEmpty():  # rows with both the same id and the same text: one of each stays
        met = met.filter("_rows = 1").unionByName(met.filter("_rows > 1").dropDuplicates(["_digest"]))
    return met.select("doc.*")
