"""Evaluation metrics and geometry over boxes, actions and texts made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import geometry, metrics
from corpusloom.functions.text import let, words
from corpusloom.operators import corpus, elements
from corpusloom.plans.catalog import query, spread, table

STOP = ["the", "and", "of", "to", "in", "is", "a", "die", "der", "und", "la", "de", "el", "les", "et"]

_BOXES = """
i as (select l_orderkey, l_linenumber, cast(l_quantity as int) as q, l_partkey % 300 as px, l_suppkey % 70 as sy, l_orderkey % 11 as o from lineitem),
boxes as (select l_orderkey, l_linenumber, q, px as ax1, sy as ay1, px + q as ax2, sy + 2 * q as ay2, px + o as bx1, sy + o as by1, px + o + q as bx2, sy + o + 30 as by2 from i),
inter as (select *, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) as shared,
                 (ax2 - ax1) * (ay2 - ay1) as aa, (bx2 - bx1) * (by2 - by1) as ba from boxes)
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    q, px, sy, o = F.col("l_quantity").cast("int"), F.col("l_partkey") % 300, F.col("l_suppkey") % 70, F.col("l_orderkey") % 11
    return i.select("l_orderkey", "l_linenumber", q.alias("q"), geometry.box(px, sy, px + q, sy + 2 * q).alias("a"), geometry.box(px + o, sy + o, px + o + q, sy + o + 30).alias("b"))


@query(f"with {_BOXES} select q, count(*) as n, round(avg(case when aa + ba - shared <> 0 then shared / (aa + ba - shared) else 0 end), 6) as iou from inter group by q")
def box_iou_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).groupBy("q").agg(F.count("*").alias("n"), F.round(F.avg(geometry.iou(F.col("a"), F.col("b"))), 6).alias("iou"))


@query(f"""
with {_BOXES}
select q, count(*) filter (l_linenumber <> 3) as n, round(avg(shared / (aa + ba - shared)) filter (l_linenumber <> 3), 6) as iou from inter where aa + ba - shared <> 0 group by q
having count(*) filter (l_linenumber <> 3) > 0
""")
def iou_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed from printed boxes: rows that do not hold four numbers are left out of the mean."""
    printed = F.when(F.col("l_linenumber") == 3, "no box").otherwise(geometry.bounds_text(F.col("a")))
    rows = _boxes(spark, sf_dir).select("q", "b", geometry.four_numbers(printed).alias("a")).filter("a is not null")
    return rows.groupBy("q").agg(F.count("*").alias("n"), F.round(F.avg(geometry.iou(F.col("a"), F.col("b"))), 6).alias("iou"))


@query(f"""
with {_BOXES} select l_orderkey, l_linenumber,
  cast(trunc(ax1 * 720 / 1000.0) as int) as x1, cast(trunc(ay1 * 1280 / 1000.0) as int) as y1, cast(trunc(ax2 * 720 / 1000.0) as int) as x2, cast(trunc(ay2 * 1280 / 1000.0) as int) as y2,
  cast(bx1 + q as int) as wx2, cast(by1 + 30 as int) as wy2 from boxes
""")
def rescaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = geometry.rescaled(F.col("a"), 1000.0, 1000.0, 720, 1280), F.col("b")
    rows = _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", a.alias("r"), geometry.corners(b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "r.x1", "r.y1", "r.x2", "r.y2", F.col("c.x2").alias("wx2"), F.col("c.y2").alias("wy2"))


_DIRECTION = "case l_linenumber % 4 when 0 then 'up' when 1 then 'down' when 2 then 'left' else 'right' end"
_SHORT = f"""
g as (select *, {_DIRECTION} as way, (ax1 + ax2) // 2 as mx, (ay1 + ay2) // 2 as my, (ax2 - ax1) // 4 as dx, (ay2 - ay1) // 4 as dy from boxes),
s as (select *, mx + case way when 'left' then dx when 'right' then -dx else 0 end as fx, my + case way when 'up' then dy when 'down' then -dy else 0 end as fy,
             mx - case way when 'left' then dx when 'right' then -dx else 0 end as tx, my - case way when 'up' then dy when 'down' then -dy else 0 end as ty from g)
"""


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    return _boxes(spark, sf_dir).withColumn("way", F.when(n == 0, "up").when(n == 1, "down").when(n == 2, "left").otherwise("right"))


@query(f"with {_BOXES}, {_SHORT} select l_orderkey, l_linenumber, way, cast(fx as int) as fx, cast(fy as int) as fy, cast(tx as int) as tx, cast(ty as int) as ty from s")
def scroll_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ways(spark, sf_dir).select("l_orderkey", "l_linenumber", "way", geometry.short_scroll(F.col("a"), F.col("way")).alias("s")).select("l_orderkey", "l_linenumber", "way", "s.*")


@query(f"""
with {_BOXES}, {_SHORT} select l_orderkey, l_linenumber, way,
  cast(case way when 'left' then ax2 - 10 when 'right' then ax1 + 10 else mx end as int) as fx, cast(case way when 'up' then ay2 - 10 when 'down' then ay1 + 10 else my end as int) as fy,
  cast(case way when 'left' then 10 when 'right' then 710 else mx end as int) as tx, cast(case way when 'up' then 10 when 'down' then 1270 else my end as int) as ty from s
""")
def long_scroll_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ways(spark, sf_dir).select("l_orderkey", "l_linenumber", "way", geometry.long_scroll(F.col("a"), F.col("way"), 720, 1280).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", "way", "s.*")


@query(f"""
with {_BOXES}, {_SHORT}, v as (select *, (fx + tx) // 2 as cx, (fy + ty) // 2 as cy, abs(fx - tx) // 2 as ox, abs(fy - ty) // 2 as oy,
  case when fy < ty then 'down' when fy > ty then 'up' when fx < tx then 'left' else 'right' end as direction from s)
select l_orderkey, l_linenumber, direction,
  cast(cx - ox * case when direction in ('up', 'down') then 2 else 1 end as int) as x1, cast(cy - oy * case when direction in ('up', 'down') then 1 else 2 end as int) as y1,
  cast(cx + ox * case when direction in ('up', 'down') then 2 else 1 end as int) as x2, cast(cy + oy * case when direction in ('up', 'down') then 1 else 2 end as int) as y2 from v
""")
def scroll_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = geometry.short_scroll(F.col("a"), F.col("way"))
    rows = _ways(spark, sf_dir).select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", geometry.inferred_scroll(F.col("s")).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", "v.direction", "v.box.*")


@query(f"with {_BOXES}, m as (select max(ax1) as hi from boxes) select l_orderkey, l_linenumber, cast(case when ax1 = hi then ax1 - 50 when ax1 = 0 then 50 else ax1 end as int) as x from boxes, m")
def endpoint_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    top = rows.agg(F.max("a.x1").alias("hi"))
    return rows.crossJoin(F.broadcast(top)).select("l_orderkey", "l_linenumber", geometry.clamped(F.col("a.x1"), F.col("hi")).alias("x"))


@query("""
with g(k, nx, ny) as (values (0, 1, 1), (1, 1, 2), (2, 2, 1), (3, 1, 3), (4, 3, 1), (5, 1, 4), (6, 2, 2), (7, 4, 1), (8, 1, 5), (9, 5, 1), (10, 1, 6), (11, 2, 3), (12, 3, 2), (13, 6, 1)),
p as (select p_partkey, p_size * 40 + 1 as w, p_partkey % 50 * 37 + 11 as h from part),
o as (select p_partkey, w, h, k, nx, ny, abs(w::double / h - nx::double / ny) as off, w * h > 100352.0 * nx * ny as big from p, g),
m as (select *, min(off) over (partition by p_partkey) as best, min(k) filter (off = (select min(off) from o o2 where o2.p_partkey = o.p_partkey)) over (partition by p_partkey) as k0 from o)
select p_partkey, nx, ny, nx * ny as tiles from m where off = best and (k = k0 or big) qualify row_number() over (partition by p_partkey order by k desc) = 1
""")
def tile_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("p_size") * 40 + 1).cast("int"), (F.col("p_partkey") % 50 * 37 + 11).cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", geometry.tile_grid(w, h).alias("g"))
    return rows.select("p_partkey", "g.nx", "g.ny", F.size(geometry.tile_boxes(F.col("g"))).alias("tiles"))


_SETS = """
v as (select l_orderkey, l_linenumber % 3 as part, list(distinct 'p' || l_partkey % 20) filter (l_returnflag <> 'A') as predicted, list(distinct 'p' || l_partkey % 20) filter (l_linenumber <= 5) as target from lineitem group by all),
c as (select l_orderkey, part, coalesce(predicted, []) as p, coalesce(target, []) as t from v)
"""


@query(f"""
with {_SETS} select l_orderkey, cast(sum(len(t)) as int) as targets, round(coalesce(sum(len(list_intersect(p, t))) / nullif(sum(len(t)), 0), 0), 6) as recall from c group by l_orderkey
""")
def section_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled recall over three sections, read back from their printed form."""
    i = spread(table(spark, sf_dir, "lineitem"))
    name = F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string"))
    pick = lambda part, ok: F.collect_set(F.when((F.col("l_linenumber") % 3 == part) & ok, name))
    said, true = F.col("l_returnflag") != "A", F.col("l_linenumber") <= 5
    rows = i.groupBy("l_orderkey").agg(*[pick(k, said).alias(f"p{k}") for k in range(3)], *[pick(k, true).alias(f"t{k}") for k in range(3)])
    heads = {"clickable:": "0", "inputs:": "1", "scrollable:": "2"}
    text = lambda c: F.concat_ws("\n", *[x for k, head in enumerate(heads) for x in (F.lit(head), F.array_join(f"{c}{k}", "\n"))])
    back = F.struct(elements.parsed_sections(text("p"), heads).alias("p"), elements.parsed_sections(text("t"), heads).alias("t"))

    def scored(both: Column) -> Column:
        pairs = [(both["p"][k], both["t"][k]) for k in heads.values()]
        targets = sum((F.size(t) for _, t in pairs), F.lit(0))
        return F.struct(targets.alias("targets"), F.round(metrics.pooled_recall(pairs), 6).alias("recall"))

    return rows.select("l_orderkey", let(back, scored).alias("s")).select("l_orderkey", "s.targets", "s.recall")


@query(f"with {_SETS} select l_orderkey, part, round(case when len(t) > 0 then len(list_intersect(p, t)) / len(t) else 0 end, 6) as recall from c")
def ocr_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("part")).agg(
        F.collect_set(F.when(F.col("l_returnflag") != "A", name)).alias("p"), F.collect_set(F.when(F.col("l_linenumber") <= 5, name)).alias("t")
    )
    return rows.select("l_orderkey", "part", F.round(metrics.recall(F.col("p"), F.col("t")), 6).alias("recall"))


_PAIRS = """
t as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn, role, text) as gold from conversations),
pairs as (select conv_id, turn, role, text as said, gold from t where gold is not null)
"""
_F1 = """
chars as (select conv_id, turn, role, said, gold, list_distinct(list_intersect(string_split(said, ''), string_split(gold, ''))) as common from pairs),
f as (select conv_id, turn, role, said, gold,
  coalesce(list_sum(list_transform(common, lambda c: least(length(said) - length(replace(said, c, '')), length(gold) - length(replace(gold, c, ''))))), 0) as n from chars),
f1 as (select conv_id, turn, role, said, gold, case when n > 0 then 2.0::double * n / (length(said) + length(gold)) else 0 end as f1 from f)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("said"), F.lead("text").over(w).alias("gold")).filter("gold is not null")


@query(f"with {_PAIRS}, {_F1} select conv_id, turn, role, round(f1, 6) as f1 from f1")
def char_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", "role", F.round(metrics.char_f1(F.col("said"), F.col("gold")), 6).alias("f1"))


@query(f"with {_PAIRS}, {_F1} select conv_id, role, round(max(case when contains(gold, said) or contains(said, gold) then 1 else f1 end), 6) as best from f1 group by all")
def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several predictions, a contained text scoring 1."""
    score = metrics.char_f1_or_inside(F.col("said"), F.col("gold"))
    return _pairs(spark, sf_dir).groupBy("conv_id", "role").agg(F.round(F.max(score), 6).alias("best"))


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@query(f"""
with {_PAIRS}, k as (select conv_id, turn, role, said, gold,
  list_filter(list_distinct(regexp_extract_all(lower(said), '[\\p{{L}}\\p{{N}}]+')), lambda w: not list_contains({_STOP}, w)) as a,
  list_filter(list_distinct(regexp_extract_all(lower(gold), '[\\p{{L}}\\p{{N}}]+')), lambda w: not list_contains({_STOP}, w)) as b from pairs)
select conv_id, turn, role, round(case when contains(lower(gold), lower(said)) then 1 when len(list_intersect(a, b)) = 0 then 0 else 2.0::double * len(list_intersect(a, b)) / (len(a) + len(b)) end, 6) as f1 from k
""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", "role", F.round(metrics.token_f1(F.col("said"), F.col("gold"), STOP), 6).alias("f1"))


_ACT = """
case event_id % 5 when 0 then 'click(<ref>x</ref><box>[' || cast(floor(value) as int) % 412 || ',' || user_id % 732 || '][400,700]</box>)'
  when 1 then 'scroll(<box>[1,2][3,4]</box>, ' || case when value > 30 then 'up' else 'down' end || ')' when 2 then 'type(' || event_type || ' now)'
  when 3 then 'special_action(PRESS_' || case when value > 30 then 'BACK' else 'HOME' end || ')' else 'STATUS_TASK_COMPLETE' end
"""
_ACTS = f"""
a as (select user_id, event_id, {_ACT} as action, event_id % 5 as kind, cast(floor(value) as int) % 412 as x, user_id % 732 as y, event_type from events),
acts as (select *, lead(action, 5) over w as goal, lead(x, 5) over w as gx, lead(event_type, 5) over w as gtype from a window w as (order by event_id))
"""


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k, u = F.col("value"), F.col("event_id") % 5, F.col("user_id")
    x = (F.floor(v).cast("int") % 412).cast("string")
    action = (
        F.when(k == 0, F.concat(F.lit("click(<ref>x</ref><box>["), x, F.lit(","), (u % 732).cast("string"), F.lit("][400,700]</box>)")))
        .when(k == 1, F.concat(F.lit("scroll(<box>[1,2][3,4]</box>, "), F.when(v > 30, "up").otherwise("down"), F.lit(")")))
        .when(k == 2, F.concat(F.lit("type("), F.col("event_type"), F.lit(" now)")))
        .when(k == 3, F.concat(F.lit("special_action(PRESS_"), F.when(v > 30, "BACK").otherwise("HOME"), F.lit(")")))
        .otherwise("STATUS_TASK_COMPLETE")
    )
    return table(spark, sf_dir, "events").select("user_id", "event_id", action.alias("action"))


@query(f"""
with a as (select user_id, event_id, {_ACT} as action, event_id % 5 as kind, cast(floor(value) as int) % 412 as x, user_id % 732 as y, event_type from events),
b as (select p.event_id, p.action, g.action as goal, p.kind, p.x, p.y, g.x as gx, g.y as gy, p.event_type as pt, g.event_type as gt from a p join a g on g.event_id = p.event_id + 5)
select event_id, round(case when goal = 'STATUS_TASK_COMPLETE' then 1
  when kind = 0 then case when sqrt(power(x / 412.0 - gx / 412.0, 2) + power(y / 732.0 - gy / 732.0, 2)) <= 0.14 then 1 else 0 end
  when kind = 2 then case when pt = 'click' and gt = 'click' then 0 when pt = gt then 1 else 0.5 end
  else case when action = goal then 1 else 0 end end, 6) as score from b
""")
def action_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each action against the one five events later."""
    acts = _acts(spark, sf_dir)
    goals = acts.select((F.col("event_id") - 5).alias("event_id"), F.col("action").alias("goal"))
    score = metrics.gesture_match(F.col("action"), F.col("goal"), STOP)
    return acts.join(goals, "event_id").select("event_id", F.round(score, 6).alias("score"))


_NAV = """
case event_id % 3 when 0 then 'click(<ref>' || event_type || '</ref>)' when 1 then 'scroll(<box></box>,' || case when value > 30 then 'up' else 'down' end || ')' else 'input(<ref>' || event_type || '</ref>, hi)' end
"""


@query(f"""
with a as (select event_id, event_type, value, {_NAV} as action from events),
b as (select p.event_id, p.action, g.action as goal, g.event_id % 3 as kind, p.event_type as pt, g.event_type as gt, p.value > 30 as pu, g.value > 30 as gu from a p join a g on g.event_id = p.event_id + 3)
select event_id, case when kind = 1 then cast(pu = gu as int) else cast(pt = gt as int) end as same, case when kind = 1 then cast(pu = gu as int) else cast(contains(action, gt) as int) end as found from b
""")
def nav_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    ref = F.concat(F.lit("(<ref>"), F.col("event_type"), F.lit("</ref>"))
    action = (
        F.when(k == 0, F.concat(F.lit("click"), ref, F.lit(")")))
        .when(k == 1, F.concat(F.lit("scroll(<box></box>,"), F.when(F.col("value") > 30, "up").otherwise("down"), F.lit(")")))
        .otherwise(F.concat(F.lit("input"), ref, F.lit(", hi)")))
    )
    acts = table(spark, sf_dir, "events").select("event_id", action.alias("action"))
    goals = acts.select((F.col("event_id") - 3).alias("event_id"), F.col("action").alias("goal"))
    a, g = F.col("action"), F.col("goal")
    return acts.join(goals, "event_id").select("event_id", metrics.action_text_match(a, g).alias("same"), metrics.target_text_found(a, g).alias("found"))


@query("""
with types(lang) as (values ('en'), ('de'), ('fr'), ('es'), ('xx')), r as (
  select d.lang, d.source, cast(contains(replace(trim(lower(d.text), e' \\t\\n\\r'), chr(10), ' '), replace(trim(lower(b.text), e' \\t\\n\\r'), chr(10), ' ')) as int) as hit
  from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))
select t.lang, cast(coalesce(sum(hit), 0) as bigint) as total, count(hit) as n, round(coalesce(sum(hit) / nullif(count(hit), 0), 0), 6) as accuracy from types t left join r on r.lang = t.lang group by t.lang
""")
def containment_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by type over a fixed catalogue, types without rows included."""
    types = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "xx")], "lang string")
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.array("text").alias("answers"))
    items = bench.agg(F.count("*").alias("items"))
    keyed = table(spark, sf_dir, "documents").crossJoin(F.broadcast(items)).withColumn("k", F.col("doc_id") % F.col("items"))
    rows = keyed.join(bench, "k")
    scored = rows.select(F.col("lang").alias("l"), metrics.contains_any(F.col("text"), F.col("answers")).alias("hit"))
    sums = scored.groupBy("l").agg(F.sum("hit").alias("total"), F.count("*").alias("n"))
    joined = F.broadcast(types).join(sums, F.col("lang") == F.col("l"), "left")
    total, n = F.coalesce("total", F.lit(0)).cast("long"), F.coalesce("n", F.lit(0))
    return joined.select("lang", total.alias("total"), n.alias("n"), F.round(F.coalesce(F.when(n > 0, total / n), F.lit(0.0)), 6).alias("accuracy"))


_HISTORY = """
h as (select user_id, coalesce(list(distinct event_type) filter (value > 60), []) as history from events group by user_id)
"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user has done with a value above 60; users without such an event have an empty history."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("history"))


@query(f"""
with {_HISTORY}, x as (select user_id, len(list_intersect(history, ['click', 'view'])) as cv, len(list_intersect(history, ['error', 'signup'])) as es, len(list_intersect(history, ['click', 'view', 'purchase'])) as cvp from h)
select user_id, round(cvp / 3.0::double, 6) as coverage, cast(es > 0 as int) as any_passed, cast(cv = 2 as int) as all_passed, cvp as counted from x
""")
def checkpoint_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("history")
    lit = lambda *w: F.array(*map(F.lit, w))
    return _history(spark, sf_dir).select(
        "user_id",
        F.round(metrics.package_coverage(lit("click", "view", "purchase"), h), 6).alias("coverage"),
        metrics.check_passed(lit("error", "|", "signup"), h).passed.alias("any_passed"),
        metrics.check_passed(lit("click", "&", "view"), h).passed.alias("all_passed"),
        metrics.check_passed(lit("click", "view", "purchase"), h).passed.cast("long").alias("counted"),
    )


@query("""
with s as (select user_id, count(*) as steps, avg(case when event_type = 'purchase' then 1.0::double else 0 end) as rate from events group by user_id)
select user_id, steps, round(avg(rate) over w, 6) as running_rate, round(avg(steps) over w, 6) as running_steps from s
window w as (partition by user_id % 4 order by user_id rows between unbounded preceding and current row)
""")
def pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running means of pass rate and steps over tasks, per worker."""
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(F.count("*").alias("steps"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("rate")).withColumn("worker", F.col("user_id") % 4)
    one = corpus.running_mean(s, "rate", "user_id", "worker").withColumnRenamed("running", "running_rate")
    two = corpus.running_mean(one, "steps", "user_id", "worker")
    return two.select("user_id", "steps", F.round("running_rate", 6).alias("running_rate"), F.round("running", 6).alias("running_steps"))


@query("""
select event_id, case event_id % 4 when 0 then 'type(' || event_type || ')' when 1 then 'special_action(PRESS_HOME)' when 2 then
  'click(<ref></ref><box>[' || trunc(0.25 * 412)::int || ',' || trunc(0.5 * 732)::int || '][' || trunc(0.25 * 412)::int || ',' || trunc(0.5 * 732)::int || ']</box>)'
  else 'scroll(<box>[103,366][103,' || case when value > 30 then 146 else 585 end || ']</box>, ' || case when value > 30 then 'up' else 'down' end || ')' end as action from events
""")
def gesture_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    point = lambda y: F.format_string("[0.25, %s]", y)
    lift = F.when(k == 2, point(F.lit("0.5"))).otherwise(F.when(F.col("value") > 30, point(F.lit("0.2"))).otherwise(point(F.lit("0.8"))))
    raw = F.to_json(F.struct(
        F.when(k == 0, "TYPE").when(k == 1, "PRESS_HOME").otherwise("DUAL_POINT").alias("action_type"),
        point(F.lit("0.5")).alias("touch_point"), lift.alias("lift_point"), F.col("event_type").alias("typed_text"),
    ))
    return table(spark, sf_dir, "events").select("event_id", elements.gesture(raw, metrics.SCREEN_W, metrics.SCREEN_H).alias("action"))


@query("select doc_id, cast(regexp_matches(text, '^[\\u4e00-\\u9fa5]*$') as boolean) as all_chinese, cast(regexp_matches(text, '[\\u4e00-\\u9fff]') as boolean) as any_chinese from documents".replace("\\u4e00", "一").replace("\\u9fa5", "龥").replace("\\u9fff", "鿿"))
def chinese_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.functions.text import all_chinese, any_chinese

    return table(spark, sf_dir, "documents").select("doc_id", all_chinese(F.col("text")).alias("all_chinese"), any_chinese(F.col("text")).alias("any_chinese"))


@query(r"select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) as int) as words from documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words(F.col("text"))).alias("words"))
