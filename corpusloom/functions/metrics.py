"""Evaluation metrics as column expressions; averages over them are ordinary aggregations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.geometry import bounds, distance
from corpusloom.functions.text import stripped

#: Gesture radius and screen of the gesture benchmark.
RADIUS, SCREEN_W, SCREEN_H = 0.14, 412, 732


def recall(predicted: Column, target: Column) -> Column:
    """Share of the distinct targets that are predicted; 0 without targets."""
    goal = F.array_distinct(target)
    return F.coalesce(F.when(F.size(goal) > 0, F.size(F.array_intersect(predicted, goal)) / F.size(goal)), F.lit(0.0))


def pooled_recall(pairs: list[tuple[Column, Column]]) -> Column:
    """Hits over targets, both summed over several sections; 0 without targets."""
    hits = sum((F.size(F.array_intersect(p, t)) for p, t in pairs), F.lit(0))
    goals = sum((F.size(F.array_distinct(t)) for _, t in pairs), F.lit(0))
    return F.coalesce(F.when(goals > 0, hits / goals), F.lit(0.0))


def _f1(common: Column, predicted: Column, gold: Column) -> Column:
    """2PR / (P + R) from counts; 0 where either side or the overlap is empty."""
    return F.coalesce(F.when((predicted > 0) & (gold > 0) & (common > 0), 2.0 * common / (predicted + gold)), F.lit(0.0))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def common_chars(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two texts' characters."""
    shared = F.array_intersect(_chars(a), _chars(b))
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c))
    return F.aggregate(shared, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))


def char_f1(predicted: Column, gold: Column, marker: str | None = None) -> Column:
    """F1 over characters with multiplicity; 1 where the gold text holds the no-answer marker."""
    score = _f1(common_chars(predicted, gold), F.length(predicted), F.length(gold))
    return score if marker is None else F.when(gold.contains(marker), 1.0).otherwise(score)


def char_f1_or_inside(predicted: Column, gold: Column, marker: str | None = None, parity: bool = False) -> Column:
    """char_f1, but 1 where one text holds the other or the prediction holds the marker.

    An empty prediction lies inside any text; only with parity does it score 1 for that.
    """
    inside = gold.contains(predicted) | predicted.contains(gold)
    if not parity:
        inside = inside & (F.length(predicted) > 0)
    if marker is not None:
        inside = inside | predicted.contains(marker)
    return F.when(inside, 1.0).otherwise(char_f1(predicted, gold))


def token_f1(predicted: Column, gold: Column, stop_words: list[str]) -> Column:
    """F1 over distinct lower-case tokens without stop words; 1 where the prediction lies inside the gold text."""
    stop = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    tokens = lambda t: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}]+)"), 1)), stop)
    a, b = tokens(predicted), tokens(gold)
    score = _f1(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))
    return F.when(F.lower(gold).contains(F.lower(predicted)), 1.0).otherwise(score)


def normalised(text: Column, formula: bool = False) -> Column:
    """Lower case, stripped, newlines as spaces; formulas keep case and lose all spaces."""
    if formula:
        return F.replace(F.replace(stripped(text), F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit(""))
    return F.replace(stripped(F.lower(text)), F.lit("\n"), F.lit(" "))


def contains_any(predicted: Column, answers: Column, formula: bool = False) -> Column:
    """1 if any normalised answer lies inside the normalised prediction."""
    p = normalised(predicted, formula)
    return F.exists(answers, lambda a: p.contains(normalised(a, formula))).cast("int")


def verb(action: Column) -> Column:
    return F.when(action.contains("click"), "click").when(action.contains("input"), "input").when(action.contains("scroll"), "scroll")


def direction(action: Column) -> Column:
    return F.regexp_extract(action, r",\s?(up|down|left|right)\)", 1)


def ref_text(action: Column) -> Column:
    """Text between ref tags; greedy, so two on a line are taken as one."""
    return F.regexp_extract(action, r"<ref>([^,]+)</ref>", 1)


def line_text(line: Column) -> Column:
    """The text between a line's ref tags, else the whole stripped line."""
    return F.coalesce(F.nullif(ref_text(line), F.lit("")), stripped(line))


def action_text_match(predicted: Column, target: Column) -> Column:
    """1 if both actions have one verb and, for scrolls, one direction, else one text."""
    same = verb(predicted) == verb(target)
    rest = F.when(verb(target) == "scroll", direction(predicted) == direction(target)).otherwise(ref_text(predicted) == ref_text(target))
    return F.coalesce((same & rest).cast("int"), F.lit(0))


def target_text_found(predicted: Column, target: Column) -> Column:
    """1 if the target's text occurs in the prediction; scrolls compare directions."""
    text = ref_text(target)
    ok = F.when(verb(target) == "scroll", direction(predicted) == direction(target)).otherwise((text != "") & predicted.contains(text))
    return F.coalesce(ok.cast("int"), F.lit(0))


def gesture_match(predicted: Column, target: Column, stop_words: list[str], width: int = SCREEN_W, height: int = SCREEN_H) -> Column:
    """Score of a predicted gesture: clicks by distance, scrolls by direction, typing by token F1, others by equality."""
    p, t = bounds(predicted), bounds(target)
    near = distance(p.x1 / width, p.y1 / height, t.x1 / width, t.y1 / height) <= RADIUS
    both = lambda w: predicted.contains(w) & target.contains(w)
    way = lambda a: F.nullif(F.regexp_extract(a, r"scroll.*</box>,\s(\w+)\)", 1), F.lit(""))
    typed = lambda a: F.regexp_extract(a, r"type\((.*)\)", 1)
    return (
        F.when(target == "STATUS_TASK_COMPLETE", 1.0)
        .when(both("click"), F.coalesce(near.cast("double"), F.lit(0.0)))
        .when(both("scroll"), F.coalesce((way(predicted) == way(target)).cast("double"), F.lit(0.0)))
        .when(both("type"), token_f1(typed(predicted), typed(target), stop_words))
        .when(both("special_action"), (predicted == target).cast("double"))
        .otherwise(0.0)
    )


def package_coverage(packages: Column, history: Column) -> Column:
    """Share of packages that some action mentions; 0 without packages."""
    seen = F.size(F.filter(packages, lambda p: F.exists(history, lambda a: a.contains(p))))
    return F.coalesce(F.when(F.size(packages) > 0, seen / F.size(packages)), F.lit(0.0))


def check_passed(wanted: Column, history: Column, parity: bool = False) -> Column:
    """passed and total of one check: '|' in the list asks for any, '&' for all, else each counts.

    '&' is corrected to: every element occurs in some action. With parity every element must occur
    in every action.
    """
    parts = F.filter(wanted, lambda w: ~w.isin("|", "&"))
    hit = lambda w: F.exists(history, lambda a: a.contains(w))
    every = lambda w: F.forall(history, lambda a: a.contains(w))
    return (
        F.when(F.array_contains(wanted, "|"), F.struct(F.exists(parts, hit).cast("int").alias("passed"), F.lit(1).alias("total")))
        .when(F.array_contains(wanted, "&"), F.struct(F.forall(parts, every if parity else hit).cast("int").alias("passed"), F.lit(1).alias("total")))
        .otherwise(F.struct(F.size(F.filter(parts, hit)).alias("passed"), F.size(parts).alias("total")))
    )
