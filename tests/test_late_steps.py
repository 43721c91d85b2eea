"""Steps kept up by state: batches in any order, late steps, and a stream that stops and goes on."""

import random

from pyspark.sql import functions as F

from corpusloom.streaming import steps


def plain_steps(rows):
    out, last = {}, {}
    for seq, who, node in sorted(rows, key=lambda r: r[0]):
        out[who, seq] = (last.get(who), node)
        last[who] = node
    return out


def test_late_and_shuffled_batches_give_the_steps_of_the_whole_log(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.randrange(4), f"n{rng.randrange(6)}") for i in range(120)]
    shuffled = rng.sample(rows, len(rows))
    schema = "event_id long, user_id long, event_type string"

    def write(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return steps.keep_steps(stream, f"{tmp_path}/out")

    write(shuffled[:40])
    write(shuffled[40:70] + shuffled[:5])  # five steps come again
    got = {(r.who, r.seq): (r.src, r.node) for r in run().collect()}
    assert got == plain_steps(shuffled[:70])
    write(shuffled[70:])  # the stream starts again, from the state that it left
    table = run()
    assert {(r.who, r.seq): (r.src, r.node) for r in table.collect()} == plain_steps(rows)
    want = {}
    for (_, seq), (src, node) in plain_steps(rows).items():
        if src is not None:
            n, first = want.get((src, node), (0, seq))
            want[src, node] = (n + 1, min(first, seq))
    assert {(r.src, r.dst): (r.steps, r.first_seq) for r in steps.edges_of(table).collect()} == want
    assert table.filter(F.col("version") > 1).count() > 0
