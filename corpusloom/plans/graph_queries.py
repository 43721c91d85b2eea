"""Graph bookkeeping over the event log: ids, edges, paths, frontier, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.plans.catalog import query, table
from corpusloom.storage import scratch, written


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cumulative_paths(_events(spark, sf_dir), "user_id", "event_type", "event_id")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.path_nodes(_events(spark, sf_dir), "user_id", "event_type", "event_id")


_PATHS = """
paths as (
  select user_id, event_id, 'app' || user_id || '0_' || string_agg(event_type, '_') over (partition by user_id order by event_id) as name from events
)
"""
_EDGES = """
w as (select lag(event_type || '_' || event_id % 7) over (partition by user_id order by event_id) as src,
             event_type || '_' || event_id % 7 as dst from events),
edges as (select distinct src, dst from w where src is not null)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.concat_ws("_", "event_type", (F.col("event_id") % 7).cast("string"))
    return graph.edges(_events(spark, sf_dir).withColumn("node", node), "user_id", "node", "event_id")


@query("""
with f as (select user_id, min(event_id) as first_seq from events group by user_id)
select user_id, first_seq, row_number() over (order by first_seq, user_id) - 1 as id from f
""")
def first_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_seen_ids(_events(spark, sf_dir), "user_id", "event_id")


@query("""
with ids as (select event_id * 2 % 1009 as id from events),
s as (select count(*) as n, count(distinct id) as d, count(*) filter (id < 0) as below, max(id) as hi from ids)
select 'bad' as ids, n - d + below + abs(coalesce(hi + 1, 0) - n) as violations from s union all select 'good', 0
""")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations among the dense ids, and among ids with repeats and gaps."""
    bad = _events(spark, sf_dir).select((F.col("event_id") * 2 % 1009).alias("id"))
    checked = [graph.integrity(ids).select(F.lit(name).alias("ids"), "violations") for name, ids in (("good", first_seen_ids(spark, sf_dir)), ("bad", bad))]
    return checked[0].unionByName(checked[1])


@query(f"with {_EDGES} select src, dst from edges")
def edges_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"with {_EDGES} select src, string_agg(dst, ',' order by dst) as dsts, cast(count(*) as int) as n from edges group by src")
def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_union(_edges(spark, sf_dir)).withColumn("dsts", F.array_join("dsts", ","))


@query(f"with {_EDGES} select src, count(distinct dst) as children from edges group by src having count(distinct dst) > 3")
def fanout_gt3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_out(_edges(spark, sf_dir))


@query(f"""
with {_PATHS} select user_id, event_id, name, regexp_extract(name, '^(.*)_[^_]*$', 1) as parent,
  array_to_string(string_split(name, '_')[:-2], '/') as folder, cast(len(string_split(name, '_')) as int) as depth from paths
""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return _paths(spark, sf_dir).select("user_id", "event_id", "name", graph.parent_name(n).alias("parent"), graph.folder(n).alias("folder"), F.size(graph.segments(n)).alias("depth"))


@query(f"with {_PATHS} select array_to_string(string_split(name, '_')[:2], '_') as prefix, count(*) as pages from paths group by all")
def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.concat(F.lit("app"), F.col("user_id").cast("string"), F.lit("0_"), F.element_at(F.split("first", "_"), 1))
    return _nodes(spark, sf_dir).groupBy(first.alias("prefix")).agg(F.count("*").alias("pages"))


@query(f"with {_PATHS} select count(*) as pages, cast(sum(len(string_split(name, '_')) - 1) as bigint) as steps from paths")
def depth_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).agg(F.count("*").alias("pages"), F.sum("steps").alias("steps"))


@query(f"""
with {_PATHS}, p as (select distinct name from paths),
kids as (select distinct regexp_extract(name, '^(.*)_[^_]*$', 1) as parent, regexp_extract(name, '_([^_]*)$', 1) as action from p)
select parent as name, string_agg(action, ',' order by action) as actions from kids where parent in (select name from p) group by parent
""")
def actions_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page actions rebuilt from page names alone, as after a lost file."""
    return graph.actions_from_names(_paths(spark, sf_dir)).withColumn("actions", F.array_join("actions", ","))


@query(f"""
with {_PATHS}, s as (select name, cast(regexp_extract(name, '^app([0-9]+)0_', 1) as bigint) as n from paths)
select coalesce(max(n), -1) + 1 as next_index from s
""")
def next_free_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.next_free_index(_paths(spark, sf_dir), r"^app(\d+)0_")


@query("""
with c as (select source, lang, count(*) as n, min(doc_id) as seq from documents group by all)
select source, lang, n, seq from c qualify row_number() over (partition by source order by n desc, seq desc) = 1
""")
def best_dir_per_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("seq"))
    return graph.best_per_group(groups, "source", "n", "seq")


_FLAGS = """
flags as (select user_id, arg_max(event_type, event_id) as flag, count(*) as n, min(event_id) as first_seq,
                 cast(sum(case when event_type = 'error' and value < 5 then 1 else 0 end) as bigint) as failed from events group by user_id),
frontier as (select user_id, flag, n, failed, row_number() over (order by first_seq, user_id) - 1 as name_id,
                    flag = 'purchase' as done, flag = 'logout' as hold from flags)
"""


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    failed = F.sum(((F.col("event_type") == "error") & (F.col("value") < 5)).cast("long")).alias("failed")
    flags = graph.last_flags(e, "user_id", "event_id", "event_type").withColumnRenamed("event_type", "flag")
    counts = e.groupBy("user_id").agg(F.count("*").alias("n"), failed)
    ids = graph.first_seen_ids(e, "user_id", "event_id").select("user_id", F.col("id").alias("name_id"))
    joined = flags.join(counts, "user_id").join(ids, "user_id")
    return joined.select("user_id", "flag", "n", "failed", "name_id", (F.col("flag") == "purchase").alias("done"), (F.col("flag") == "logout").alias("hold"))


@query(f"with {_FLAGS} select user_id, flag, n, failed, name_id, done, hold from frontier")
def frontier_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frontier(spark, sf_dir)


@query(f"""
with {_FLAGS}, canon as (select user_id, 'app' || user_id % 9 || '0_p' || user_id as name, 'app' || user_id % 9 || '0_p' || (user_id - user_id % 2) as unique_name from frontier)
select f.user_id, f.name_id, c.name from frontier f join canon c using (user_id)
where not done and not hold and c.name = c.unique_name and (c.name like 'app1%' or c.name like 'app3%' or c.name like 'app4%') and c.name not like '%\\_p4' escape '\\'
""")
def frontier_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    name = lambda k: F.concat(F.lit("app"), (u % 9).cast("string"), F.lit("0_p"), k.cast("string"))
    f = _frontier(spark, sf_dir).withColumn("name", name(u)).withColumn("unique_name", name(u - u % 2))
    return graph.eligible(f, 10, ["app1", "app3", "app4"], ["p4"]).select("user_id", "name_id", "name")


@query(f"with {_FLAGS} select user_id, name_id, user_id % 9 = 3 or done as done, cast(user_id % 9 as int) as shard from frontier where user_id % 9 in (3, 5)")
def frontier_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frontier split among workers: one worker has written its shard anew, another reads that and its own."""
    path = scratch(spark, "shards")
    rows = _frontier(spark, sf_dir).select("user_id", "name_id", "done", (F.col("user_id") % 9).cast("int").alias("shard"))
    graph.write_shards(rows, path, "shard")
    graph.write_shards(written(graph.read_shards(spark, path, "shard", [3]).withColumn("done", F.lit(True)), "done"), path, "shard")
    return graph.read_shards(spark, path, "shard", [3, 5]).select("user_id", "name_id", "done", "shard")


@query(f"with {_FLAGS} select user_id, failed from frontier where failed < 3")
def failures_below_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frontier(spark, sf_dir).filter("failed < 3").select("user_id", "failed")


@query(f"""
with {_FLAGS}, c as (select count(*) as m from frontier)
select flag, user_id, name_id from frontier, c where not done
qualify row_number() over (partition by flag order by ((name_id - 17) % m + m) % m, name_id) = 1
""")
def round_robin_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frontier(spark, sf_dir)
    return graph.round_robin(f.filter("not done"), 17, f.count(), "flag").select("flag", "user_id", "name_id")


@query(f"""
with {_FLAGS}, f as (select name_id, n % 7 as depth, not done as ok from frontier), c as (select count(*) as m from f), s(start) as (values (0), (3), (7), (11), (12), (40)),
b as (select start, case when ok then start when depth <= 3 then (start + 1) % m else cast(('0x' || substr(md5('w|' || start), 1, 8)) as bigint) % m end as begin_, m from s join f on name_id = start, c)
select start, name_id from b join f on ok qualify row_number() over (partition by start order by ((name_id - begin_) % m + m) % m) = 1
""")
def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next page from a few places of the frontier, in order where the walk is shallow."""
    f = _frontier(spark, sf_dir).select("name_id", (F.col("n") % 7).alias("depth"), (~F.col("done")).alias("ok"))
    starts = spark.createDataFrame([(k,) for k in (0, 3, 7, 11, 12, 40)], "start long")
    return graph.next_pages(f, starts, f.count(), "w")


@query(f"""
with {_PATHS}, pages as (select name, min(event_id) as page_id from paths group by name),
holds as (select name as prefix, page_id as since from pages where page_id % 5 = 0)
select p.page_id, p.name, exists (select 1 from holds h where p.page_id >= h.since and (p.name = h.prefix or starts_with(p.name, h.prefix || '_'))) as hold
from pages p
""")
def flag_hold_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a hold on a page before them reaches: names begin with the walker, so the pages above one are the steps before it."""
    held = graph.held_on_walks(_events(spark, sf_dir).select("user_id", "event_type", "event_id"), "user_id", "event_id", F.col("event_id") % 5 == 0)
    paths = graph.cumulative_paths(held, "user_id", "event_type", "event_id", keep=["hold"])
    return paths.select(F.col("event_id").alias("page_id"), "name", "hold")


@query("""
select user_id, coalesce(string_agg(distinct event_type, ',' order by event_type) filter (value >= 40), '') as valid,
       coalesce(string_agg(distinct event_type, ',' order by event_type) filter (value < 40), '') as invalid from events group by user_id
""")
def valid_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda ok: F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("event_type")))), ",")
    return _events(spark, sf_dir).groupBy("user_id").agg(some(F.col("value") >= 40).alias("valid"), some(F.col("value") < 40).alias("invalid"))


@query("""
select user_id, event_id, string_agg(event_type, ' > ') over w as memory, lead(event_type) over (partition by user_id order by event_id) as next
from events window w as (partition by user_id order by event_id rows between 4 preceding and current row)
""")
def memory_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last actions before each step as text, and the action that follows."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    memory = F.array_join(F.collect_list("event_type").over(w.rowsBetween(-4, 0)), " > ")
    return _events(spark, sf_dir).select("user_id", "event_id", memory.alias("memory"), F.lead("event_type").over(w).alias("next"))


@query("select user_id, event_type, count(*) as visits, min(ts) as first_ts, max(ts) as last_ts from events group by all")
def event_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that the streaming upkeep reaches once it has read all."""
    from corpusloom.streaming.upsert import visits

    return visits(_events(spark, sf_dir))


@query("select user_id, event_type, count(*) as visits, min(ts) as first_ts, max(ts) as last_ts from events group by all")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a streaming query over the event files, run until it has read what is there."""
    from corpusloom.streaming.upsert import upkeep, visits_of_batches

    return upkeep(_event_stream(spark, sf_dir), scratch(spark, "stream"), visits_of_batches)["visits"]


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _events(spark, sf_dir).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("""
with p as (select user_id, event_id, lag(event_type) over (partition by user_id order by event_id) as src, event_type as dst from events)
select src, dst, count(*) as steps, min(event_id) as first_seq from p where src is not null group by src, dst
""")
def stream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges kept up by a stream with a state for each walker: steps between consecutive nodes, late ones put right."""
    from corpusloom.streaming.steps import edges_of, keep_steps

    return edges_of(keep_steps(_event_stream(spark, sf_dir), scratch(spark, "stream")))


@query("select user_id, event_type as node, arg_max(event_id, event_id) as last_seq, arg_max(value, event_id) as flag from events group by all")
def stream_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier kept up by a stream: the last flag of each walker's node."""
    from corpusloom.streaming.upsert import upkeep, walks_of_batches

    return upkeep(_event_stream(spark, sf_dir), scratch(spark, "stream"), walks_of_batches)["frontier"].select("user_id", "node", "last_seq", "flag")


@query("select user_id, event_type as node, min(event_id) as page_id, (select min(event_id) from events f where f.event_type = events.event_type) as unique_id from events group by all")
def stream_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and their canonical ones kept up by a stream: a node's first page anywhere stands for it."""
    from corpusloom.streaming.upsert import upkeep, walks_of_batches

    made = upkeep(_event_stream(spark, sf_dir), scratch(spark, "stream"), walks_of_batches)
    canon = made["canonical"].select("node", "unique_id")
    return made["pages"].join(canon, "node").select("user_id", "node", "page_id", "unique_id")
