"""Steps of walks kept up by a stream that may bring them late and in any order.

Each walker's state is the list of its steps: one request to the store reads it and one appends what a batch brings, however many steps that is. A step that arrives between two known ones changes two rows:
its own, which follows the step before it, and that of the step after it, which now follows the new one. Such rows
go out with a version that grows with every batch of the walker, and the table of steps keeps the newest version of each, so it is
the same whatever the order and the sizes of the batches. A batch reads the whole walk of those walkers that it has steps of.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.streaming.upsert import latest, upsert_to

#: List state needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Walks(StatefulProcessor):
    """Emits who, seq, src, node, version for every step that is new or has another step before it than it had."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getListState("steps", "seq bigint, node string, version bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, version = {}, 1
        for seq, node, held in self.steps.get():
            known[int(seq)] = node
            version = max(version, int(held) + 1)
        new: dict[int, str | None] = {}
        for batch in rows:
            for seq, node in zip(batch["seq"].tolist(), batch["node"].tolist()):
                if seq == seq and seq is not None and int(seq) not in known:  # a step that comes again changes nothing
                    new.setdefault(int(seq), node)
        if not new:
            return
        self.steps.appendList([(seq, node, version) for seq, node in new.items()])
        known |= new
        order = sorted(known)
        touched = set()
        for seq in new:
            at = bisect_left(order, seq)
            touched.update(order[at : at + 2])
        out = []
        for seq in sorted(touched):
            at = bisect_left(order, seq)
            out.append((key[0], seq, known[order[at - 1]] if at else None, known[seq], version))
        yield pd.DataFrame(out, columns=["who", "seq", "src", "node", "version"])

    def close(self) -> None:
        pass


def corrections(log: DataFrame, who: str, node: str, seq: str) -> DataFrame:
    """A stream of who, seq, src, node, version: steps that are new or follow another step than before."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    slim = log.select(F.col(who).alias("who"), F.col(seq).cast("long").alias("seq"), F.col(node).cast("string").alias("node"))
    kind = slim.schema["who"].dataType.simpleString()
    return slim.groupBy("who").transformWithStateInPandas(
        _Walks(), f"who {kind}, seq long, src string, node string, version long", outputMode="Update", timeMode="None"
    )


def keep_steps(log: DataFrame, path: str, who: str = "user_id", node: str = "event_type", seq: str = "event_id", then: Callable | None = None) -> DataFrame:
    """Runs the stream over what is there now and returns the table of steps: who, seq, src (null at a walk's first step), node, version.

    Called again on the same path it goes on from the state that it left. `then` is called with each batch, as by foreachBatch.
    """
    spark: SparkSession = log.sparkSession
    merge = upsert_to(f"{path}/steps", ["who", "seq"], "version")

    def both(batch: DataFrame, batch_id: int) -> None:
        merge(batch, batch_id)
        if then:
            then(batch, batch_id)

    query = (
        corrections(log, who, node, seq).writeStream.foreachBatch(both).outputMode("update")
        .option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return latest(spark, f"{path}/steps")


def edges_of(steps: DataFrame) -> DataFrame:
    """src, dst, steps, first_seq: the distinct steps between nodes."""
    made = steps.filter("src is not null").groupBy("src", F.col("node").alias("dst"))
    return made.agg(F.count("*").alias("steps"), F.min("seq").alias("first_seq"))
