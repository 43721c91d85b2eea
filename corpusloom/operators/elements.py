"""Interactive elements of rendered pages: numbering, categories, actions, mappings both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.geometry import bounds, short_scroll
from corpusloom.functions.text import attribute, found, inner_text, let, lines, stripped

DIRECTIONS = ("up", "down", "left", "right")
CATEGORIES = ("Clickables", "Scrollables", "Inputs")


def is_interactive(line: Column) -> Column:
    return line.contains('clickable="true"') | line.contains('scrollable="true"') | line.contains("input")


def numbered(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """key, idx (from 1), line: the interactive lines of each page in order."""
    exploded = pages.select(key, F.posexplode(html).alias("pos", "line")).filter(is_interactive(F.col("line")))
    order = Window.partitionBy(key).orderBy("pos")
    return exploded.select(key, F.row_number().over(order).alias("idx"), stripped(F.col("line")).alias("line"))


def category(line: Column) -> Column:
    return (
        F.when(line.contains("input") | line.contains("EditText"), "Inputs")
        .when(line.contains('scrollable="true"'), "Scrollables")
        .when(line.contains('clickable="true"'), "Clickables")
    )


def description(line: Column) -> Column:
    """The description attribute, else the inner text, else 'Empty' and the class; null without any."""
    text = F.nullif(inner_text(line), F.lit(""))
    base = F.coalesce(attribute(line, "description"), F.when(attribute(line, "class").isNotNull(), F.coalesce(text, F.concat(F.lit("Empty "), attribute(line, "class")))))
    where = found(line, r'bounds="([^"]+)"')
    return F.when(line.contains('scrollable="true"') & where.isNotNull(), F.concat(base, F.lit(" ("), where, F.lit(")"))).otherwise(base)


def categorised(elements: DataFrame) -> DataFrame:
    """elements with category, description and rank, in output order by (rank, idx); nameless ones go."""
    c = category(F.col("line"))
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), c)
    return elements.withColumn("category", c).withColumn("description", description(F.col("line"))).withColumn("rank", rank).filter("category is not null and description is not null")


def actions(elements: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """key, ord, action: what can be done on each page, in order, each action once.

    Clickables are clicked, scrollables scrolled four ways, inputs clicked and given each text.
    """
    i = F.col("idx").cast("string")
    click = F.concat(F.lit("click("), i, F.lit(")"))
    scrolls = [F.concat(F.lit("scroll("), i, F.lit(f",{d})")) for d in DIRECTIONS]
    types = [F.concat(F.lit("input("), i, F.lit(f",{t})")) for t in dict.fromkeys(texts)]
    every = F.when(F.col("category") == "Clickables", F.array(click)).when(F.col("category") == "Scrollables", F.array(*scrolls)).otherwise(F.array(click, *types))
    rows = elements.select(key, "rank", "idx", F.posexplode(every).alias("k", "action"))
    first = rows.groupBy(key, "action").agg(F.min(F.struct("rank", "idx", "k")).alias("at"))
    order = Window.partitionBy(key).orderBy("at")
    return first.select(key, F.row_number().over(order).alias("ord"), "action")


def command(action: Column, elements: Column, window_w: int, window_h: int) -> Column:
    """An executable command from verb(index, ..): elements is a map from index to line.

    click, press, zoom and pinch take the element, scroll its end points (long with a third
    parameter), input the element and the text. An index that is not in the map leaves it empty.
    """
    from corpusloom.functions.geometry import long_scroll

    verb = F.lower(stripped(F.element_at(F.split(action, r"\("), 1)))
    params = F.split(F.regexp_replace(F.regexp_extract(action, r"\((.*)$", 1), r"\)+$", ""), ",")
    index = F.when(F.element_at(params, 1).rlike(r"^\d+$"), F.element_at(params, 1).cast("int"))
    line = F.coalesce(F.element_at(elements, index), F.lit(""))
    box = bounds(F.regexp_extract(line, r'bounds="([^"]+)"', 1))
    way = F.get(params, F.lit(1))
    scroll = lambda b, w: F.when(F.size(params) > 2, long_scroll(b, w, window_w, window_h)).otherwise(short_scroll(b, w))
    ends = let(F.struct(box.alias("b"), way.alias("w")), lambda s: scroll(s.b, s.w))
    path = F.coalesce(let(ends, lambda e: F.format_string("([%d, %d], [%d, %d])", e.fx, e.fy, e.tx, e.ty)), F.lit(""))
    typed = F.when((F.size(params) > 1) & (line != ""), F.concat(line, F.lit(", '"), F.get(params, F.lit(1)), F.lit("'"))).otherwise(line)
    inner = F.when(verb == "scroll", path).when(verb == "input", typed).otherwise(line)
    return F.concat(F.when(verb.isin("click", "press", "zoom", "pinch", "scroll", "input"), verb).otherwise(""), F.lit("("), inner, F.lit(")"))


def action_space(line: Column, line_box: Column) -> Column:
    """Model actions of one line with its box: an array, empty where it offers none.

    Boxes come from the same line of the page rendered with bounds; a missing box is left out
    instead of being carried over from an earlier line.
    """
    at = F.coalesce(F.concat(F.lit("<box>"), line_box, F.lit("</box>")), F.lit(""))
    text = F.nullif(inner_text(line), F.lit(""))
    name = F.coalesce(text, attribute(line, "description"))
    typed = F.array(F.coalesce(F.concat(F.lit("input(<ref>"), text, F.lit("</ref>"), at, F.lit(")")), F.concat(F.lit("input("), at, F.lit(")"))))
    click = F.array(F.concat(F.lit("click(<ref>"), name, F.lit("</ref>"), at, F.lit(")")))
    scroll = F.array(*[F.concat(F.lit("scroll("), at, F.lit(f",{d})")) for d in DIRECTIONS])
    return (
        F.when(line.contains("<input"), typed)
        .when(line.contains('clickable="true"') & name.isNotNull(), click)
        .when(line.contains('scrollable="true"') & line_box.isNotNull(), scroll)
        .otherwise(F.array().cast("array<string>"))
    )


def zipped_lines(pages: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """key, pos, a, b: the lines of two renderings side by side, as far as both go."""
    a, b = lines(F.col(one)), lines(F.col(two))
    n = F.least(F.size(a), F.size(b))
    return pages.select(key, F.posexplode(F.arrays_zip(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"))).alias("pos", "z")).select(key, "pos", "z.a", "z.b")


def sections(clicks: Column, inputs: Column, scrolls: Column) -> Column:
    """Three headed sections of action lines; null where there is nothing to click or type into."""
    text = F.concat_ws("\n", F.lit("clickable:"), F.array_join(clicks, "\n"), F.lit("inputs:"), F.array_join(inputs, "\n"), F.lit("scrollable:"), F.array_join(scrolls, "\n"))
    return F.when((F.size(clicks) > 0) | (F.size(inputs) > 0), text)


def parsed_sections(text: Column, heads: dict[str, str]) -> Column:
    """A map from section to its lines, from a text whose sections begin with a head line. A line is looked at once, whatever their number."""

    def named(line: Column) -> Column:
        head = F.lit(None).cast("string")
        for mark, name in heads.items():
            head = F.when(line.startswith(mark), name).otherwise(head)
        return head

    def cut(own: Column) -> Column:
        """The lines from each head to the next."""
        at = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.get(own, i)["head"].isNotNull())
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(own))
        return let(at, lambda at: F.transform(at, lambda i, k: F.struct(F.get(own, i)["head"].alias("s"), F.slice(own, i + 2, end(at, k) - i - 1).alias("l"))))

    def of_name(parts: Column, name: str) -> Column:
        own = F.flatten(F.transform(F.filter(parts, lambda p: (p.s == name) & (p.s != "")), lambda p: p.l))
        return F.transform(F.filter(own, lambda x: x["line"] != ""), lambda x: x["line"])

    own = F.transform(F.split(text, "\n"), lambda x: F.struct(named(x).alias("head"), stripped(x).alias("line")))
    parts = let(own, cut)
    return let(parts, lambda p: F.create_map(*[x for name in heads.values() for x in (F.lit(name), of_name(p, name))]))


def key_of(line: Column) -> Column:
    """key, action_type of an action line: its text, or its description where that is shorter than two characters; null where both are."""
    text = F.coalesce(inner_text(line), F.lit(""))
    key = F.when(F.length(text) > 1, text).otherwise(F.coalesce(stripped(attribute(line, "description")), text))
    typed = stripped(F.regexp_replace(F.element_at(F.split(line, ","), -1), r"^\)+|\)+$", ""))
    kind = F.when(line.startswith("input"), typed).when(line.startswith("click"), "click").when(line.startswith("scroll"), "scroll")
    return F.when(F.length(key) > 1, F.struct(key.alias("key"), kind.alias("action_type")))


def sampled_key(rows: DataFrame, page: str, seed: str) -> DataFrame:
    """One keyed action per page: any that is no click, else a click whose key is all Chinese."""
    from corpusloom.functions.text import all_chinese
    from corpusloom.operators.graph import hash_order

    rank = F.when(F.col("action_type") != "click", 0).when(all_chinese(F.col("key")), 1)
    order = Window.partitionBy(page).orderBy("_rank", hash_order(seed, page, "key", "action_type"))
    ranked = rows.withColumn("_rank", rank).filter("_rank is not null").withColumn("_k", F.row_number().over(order))
    return ranked.filter("_k = 1").drop("_rank", "_k")


def element_labels(zipped: DataFrame, key: str) -> DataFrame:
    """key, line, label, box: each distinct line's name and box, from its first place (zipped_lines)."""
    box = found(F.col("b"), r'bounds="(\[\d+,\d+\]\[\d+,\d+\])"')
    label = F.coalesce(F.nullif(inner_text(F.col("a")), F.lit("")), attribute(F.col("a"), "description"))
    rows = zipped.select(key, "pos", F.col("a").alias("line"), label.alias("label"), box.alias("box")).filter("box is not null")
    return rows.groupBy(key, "line").agg(F.min_by(F.struct("label", "box"), "pos").alias("v")).select(key, "line", "v.label", "v.box")


def scroll_ends(box: Column, direction: Column) -> Column:
    """The end points of a short scroll as they stand in a raw command."""
    ends = let(F.struct(box.alias("b"), direction.alias("d")), lambda s: short_scroll(s.b, s.d))
    return let(ends, lambda e: F.when(e.isNotNull(), F.format_string("[%d, %d], [%d, %d]", e.fx, e.fy, e.tx, e.ty)))


def raw_command(action: Column, elements: Column) -> Column:
    """The raw command of a model action; elements is a map from click actions and input references to what they stand for.

    A click is looked up whole, an input by its first argument, with its text behind a comma; a scroll's end
    points come from its box, with or without box tags. Null where a click or scroll stands for nothing.
    """
    verb = F.lower(stripped(F.element_at(F.split(action, r"\("), 1)))
    scroll = r"\((?:<box>)?\[(\d+),(\d+)\]\[(\d+),(\d+)\](?:</box>)?,\s?(\w+)\)"
    ends = scroll_ends(bounds(action), found(action, scroll, 5))
    params = F.split(F.regexp_replace(F.regexp_extract(action, r"\((.*)$", 1), r"\)+$", ""), ", ")
    line = F.element_at(elements, F.element_at(params, 1))
    typed = F.coalesce(F.when(F.size(params) > 1, F.concat(line, F.lit(","), F.get(params, F.lit(1)))).otherwise(line), F.lit(""))
    return (
        F.when(verb == "click", F.element_at(elements, action))
        .when(verb == "scroll", F.concat(F.lit("scroll("), ends, F.lit(")")))
        .when(verb == "input", F.concat(F.lit("input("), typed, F.lit(")")))
    )


def to_model_action(raw: DataFrame, labels: DataFrame, key: str, parity: bool = False, scrolls: DataFrame | None = None) -> DataFrame:
    """raw(key, action) with model: the model action for verb(line[, text]); null where no line matches.

    A scroll's end points are matched with those of the page's own scroll actions, scrolls(key, item). With parity a line that
    holds a comma never matches, as arguments were split there, and neither does a scroll whose box has tags.
    """
    if scrolls is not None:
        box = bounds(F.col("item"))
        usable = scrolls if not parity else scrolls.filter(~F.col("item").contains("<box>"))
        ends = scroll_ends(box, found(F.col("item"), r",\s?(\w+)\)$"))
        items = usable.select(key, "item", ends.alias("_ends")).groupBy(key, "_ends").agg(F.min("item").alias("_scroll"))
        asked = raw.withColumn("_ends", found(F.col("action"), r"^scroll.*?(\[\d+, \d+\], \[\d+, \d+\])"))
        met = asked.join(items, [key, "_ends"], "left")
        return to_model_action(met, labels, key, parity).withColumn("model", F.coalesce("_scroll", "model")).select(*raw.columns, "model")
    verb = F.element_at(F.split("action", r"\("), 1)
    body = F.regexp_extract("action", r"^\w+\((.*)\)$", 1)
    line = F.when(verb == "input", F.regexp_extract(body, r"^(.*), '", 1)).otherwise(body)
    text = F.regexp_extract(body, r", '([^']*)'$", 1)
    if parity:
        line = F.when(~line.contains(","), line)
    named = raw.withColumn("line", line).join(labels, [key, "line"], "left")
    ref = F.concat(F.lit("<ref>"), "label", F.lit("</ref><box>"), "box", F.lit("</box>"))
    return named.withColumn("model", F.when(verb == "click", F.concat(F.lit("click("), ref, F.lit(")"))).when(verb == "input", F.concat(F.lit("input("), ref, F.lit(", "), text, F.lit(")")))).select(*raw.columns, "model")


def gesture(action: Column, width: int, height: int) -> Column:
    """An action string from a gesture's JSON (action_type, touch_point, lift_point, typed_text)."""
    get = lambda name: F.get_json_object(action, f"$.{name}")
    part = lambda name, i, size: (F.regexp_extract(get(name), r"\[(\d+\.\d+), (\d+\.\d+)\]", i).cast("double") * size).cast("int")
    tx, ty, lx, ly = part("touch_point", 1, width), part("touch_point", 2, height), part("lift_point", 1, width), part("lift_point", 2, height)
    box = F.format_string("<box>[%d,%d][%d,%d]</box>", tx, ty, lx, ly)
    way = F.when(ty > ly, "up").when(ty < ly, "down").when(tx > lx, "left").otherwise("right")
    kind = get("action_type")
    return (
        F.when((kind == "DUAL_POINT") & (tx == lx) & (ty == ly), F.concat(F.lit("click(<ref></ref>"), box, F.lit(")")))
        .when(kind == "DUAL_POINT", F.concat(F.lit("scroll("), box, F.lit(", "), way, F.lit(")")))
        .when(kind == "TYPE", F.concat(F.lit("type("), F.coalesce(get("typed_text"), F.lit("")), F.lit(")")))
        .when(kind.isin("PRESS_BACK", "PRESS_ENTER", "PRESS_HOME"), F.concat(F.lit("special_action("), kind, F.lit(")")))
        .when(kind == "STATUS_TASK_COMPLETE", "STATUS_TASK_COMPLETE")
    )


def summary(inputs: Column, clicks: Column) -> Column:
    """A sentence on what a page offers, blank entries left out."""
    some = lambda c: F.filter(c, lambda x: stripped(x) != "")
    i, c = some(inputs), some(clicks)
    typed = F.when(F.size(i) > 0, F.concat(F.lit("Inputs: "), F.array_join(i, ", "), F.lit("."))).otherwise("No inputs.")
    clicked = F.when(F.size(c) > 0, F.concat(F.lit("Clickable: "), F.array_join(c, ", "), F.lit("."))).otherwise("Nothing to click.")
    return F.concat_ws(" ", typed, clicked)


def task_prompt(goal: Column, history: Column, width: int, height: int) -> Column:
    """A goal and the actions done so far, from the gestures' JSON; the last gesture is the one to predict."""
    done = F.transform(F.slice(history, 1, F.greatest(F.size(history) - 1, F.lit(0))), lambda a: gesture(a, width, height))
    return F.concat(F.lit("Task: "), goal, F.lit("\nDone so far:\n"), F.array_join(done, "\n"))


def readdressed(command_: Column, old: str, new: str) -> Column:
    """A device command for another address."""
    return F.replace(command_, F.lit(old), F.lit(new))
