"""Corpus building: filters, splits, statistics, conversations and masked training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from corpusloom.functions.bpe import ByteLevel
from corpusloom.operators.graph import folder, parent_name, segments
from corpusloom.storage import written

#: Least sizes of a screenshot, of a page and of its file.
LEAST_IMAGE, LEAST_PAGE, LEAST_FILE = 1024, 200, 512
#: Fixed value: what training ignores.
IGNORE = -100


def starts_with_any(c: Column, heads: list[str]) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | c.startswith(h)
    return out


def split_by_prefix(rows: DataFrame, name: str, held_out: list[str]) -> DataFrame:
    """rows with split: test where the name starts with a held-out head, else train."""
    return rows.withColumn("split", F.when(starts_with_any(F.col(name), held_out), "test").otherwise("train"))


def without(rows: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """rows whose key is not held out."""
    return rows.join(held_out.select(key).distinct(), key, "left_anti")


def large_enough(page: Column, file_bytes: Column | None = None, image_bytes: Column | None = None) -> Column:
    ok = F.length(page) >= LEAST_PAGE
    if file_bytes is not None:
        ok = ok & (file_bytes >= LEAST_FILE)
    if image_bytes is not None:
        ok = ok & (image_bytes >= LEAST_IMAGE)
    return ok


#: Fixed value: how a text ends that stands for one that could not be made.
ERROR = " error"


def known(text: Column) -> Column:
    """The text, null where it only says that there is none."""
    return F.when(~text.endswith(ERROR) | text.contains("\n") | (F.size(F.split(text, " ")) != 2), text)


def no_keyword(text: Column, keywords: list[str]) -> Column:
    return ~F.exists(F.array(*map(F.lit, keywords)), lambda k: text.contains(k))


def conversation(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """key, conversations: the ordered turns of each conversation as from and value."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("from"), F.col(text).alias("value"))))
    return turns.groupBy(key).agg(F.transform(ordered, lambda s: F.struct(s["from"].alias("from"), s["value"].alias("value"))).alias("conversations"))


def chat_rows(talks: DataFrame, key: str, max_len: int, system: str = "You are a helpful assistant.", pad: str = "<pad>") -> DataFrame:
    """key, input, labels, mask: token rows of one length, in the chat format with role marks.

    talks(key, conversations). Tokens are the words of a text here; ids follow from any dictionary. A
    first turn that is not the user's is dropped, as are turns of other roles; user turns and role marks are ignored by training,
    answers and the marks around them are kept, and rows are cut after joining all turns. Ignored
    places hold null in labels, which stand for IGNORE.
    """
    word = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    one = lambda *v: F.array(*[F.lit(x) for x in v])
    nothing = F.lit(None).cast("string")
    head_words = F.concat(one("<s>", "system", "\n"), word(F.lit(system)), one("<e>", "\n"))
    head_label = F.concat(one("<s>"), F.array_repeat(nothing, F.size(head_words) - 3), one("<e>", "\n"))
    turns = F.when(F.element_at(F.col("conversations"), 1)["from"] != "user", F.slice("conversations", F.lit(2), F.size("conversations"))).otherwise(F.col("conversations"))
    turns = F.filter(turns, lambda t: t["from"].isin("user", "assistant"))

    def rendered(t: Column) -> Column:
        return F.concat(F.array(F.lit("<s>"), t["from"], F.lit("\n")), word(t["value"]), one("<e>", "\n"))

    def kept(t: Column) -> Column:
        body = word(t["value"])
        asked = F.concat(one("<s>"), F.array_repeat(nothing, F.size(body) + 2), one("<e>", "\n"))
        told = F.concat(one("<s>"), F.array_repeat(nothing, 2), body, one("<e>", "\n"))
        return F.when(t["from"] == "user", asked).otherwise(told)

    made = talks.select(
        key,
        F.concat(head_words, F.flatten(F.transform(turns, rendered))).alias("i"),
        F.concat(head_label, F.flatten(F.transform(turns, kept))).alias("l"),
    )
    room = F.greatest(F.lit(max_len) - F.size("i"), F.lit(0))
    full = lambda c, fill: F.slice(F.concat(c, F.array_repeat(fill, room)), 1, max_len)
    filled = made.select(key, full(F.col("i"), F.lit(pad)).alias("input"), full(F.col("l"), nothing).alias("labels"))
    return filled.withColumn("mask", F.transform("input", lambda w: w != pad))


def byte_ids(text: Column) -> Column:
    """Token ids of a text by its UTF-8 bytes, 0 to 255."""
    each = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")  # a character for each byte
    ids = F.transform(F.filter(each, lambda c: c != ""), lambda c: F.ascii(c))
    return F.coalesce(ids, F.array().cast("array<int>"))


def chat_ids(
    talks: DataFrame, key: str, max_len: int | None, literal: Callable[[str], Column] = lambda s: byte_ids(F.lit(s)),
    of_turn: Callable[[Column, str], Column] = lambda t, field: byte_ids(t[field]), start: int = 256, end: int = 257, pad: int = 258,
    system: str = "You are a helpful assistant.", cut: bool = True,
) -> DataFrame:
    """key, input_ids, labels, attention_mask: chat_rows() in token ids, IGNORE where training does not look.

    literal gives the ids of the format's own texts, of_turn those of a turn's role (from) and text (value); bytes by default. start
    and end are the marks around a turn, pad fills up. The newline is a token of the text's own. Without max_len rows are
    neither cut nor filled up; with it they are filled up to it, and longer ones are cut unless cut is False.
    """
    one = lambda v: F.array(F.lit(v))
    line = literal("\n")
    skip = lambda n: F.array_repeat(F.lit(IGNORE), n)
    close = F.concat(one(end), line)
    head = F.concat(one(start), literal("system"), line, literal(system))
    turns = F.when(F.element_at(F.col("conversations"), 1)["from"] != "user", F.slice("conversations", F.lit(2), F.size("conversations"))).otherwise(F.col("conversations"))
    turns = F.filter(turns, lambda t: t["from"].isin("user", "assistant"))
    # Each text is encoded once; what follows takes its ids.
    coded = F.transform(turns, lambda t: F.struct(t["from"].alias("from"), F.concat(one(start), of_turn(t, "from"), line).alias("role"), of_turn(t, "value").alias("ids")))
    asked = lambda t: F.concat(one(start), skip(F.size(t["role"]) + F.size(t["ids"]) - 1), close)
    told = lambda t: F.concat(one(start), skip(F.size(t["role"]) - 1), t["ids"], close)
    made = talks.select(key, coded.alias("_coded")).select(
        key,
        F.concat(head, close, F.flatten(F.transform("_coded", lambda t: F.concat(t["role"], t["ids"], close)))).alias("i"),
        F.concat(one(start), skip(F.size(head) - 1), close, F.flatten(F.transform("_coded", lambda t: F.when(t["from"] == "user", asked(t)).otherwise(told(t))))).alias("l"),
    )
    if max_len is None:
        full = lambda c, fill: c
    else:
        room = F.greatest(F.lit(max_len) - F.size("i"), F.lit(0))
        filled_up = lambda c, fill: F.concat(c, F.array_repeat(F.lit(fill), room))
        full = lambda c, fill: F.slice(filled_up(c, fill), 1, max_len) if cut else filled_up(c, fill)
    rows = made.select(key, full(F.col("i"), pad).alias("input_ids"), full(F.col("l"), IGNORE).alias("labels"))
    return rows.withColumn("attention_mask", F.transform("input_ids", lambda t: t != pad))


def chat_token_ids(turns: DataFrame, key: str, turn: str, role: str, text: str, max_len: int | None, vocabulary: ByteLevel, system: str = "You are a helpful assistant.") -> DataFrame:
    """chat_ids() over a byte-level vocabulary. The marks around turns and the filling are the three ids after its last.

    Roles and texts are encoded row by row before turns are put together. Null roles and texts have no tokens.
    """
    encoded = turns.select(key, turn, role, text, vocabulary.ids(F.col(role)).alias("_role"), vocabulary.ids(F.col(text)).alias("_text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("from"), F.col(text).alias("value"), F.col("_role").alias("from_ids"), F.col("_text").alias("value_ids"))))
    talks = encoded.groupBy(key).agg(ordered.alias("conversations"))
    marks = [len(vocabulary.bytes) + k for k in range(3)]
    none = F.array().cast("array<int>")
    return chat_ids(talks, key, max_len, lambda s: F.array(*map(F.lit, vocabulary.encode(s))), lambda t, field: F.coalesce(t[f"{field}_ids"], none), *marks, system)


#: Instructions by task; those of a page's actions, description and next step stand on a line of their own.
POOLS = {
    "structure": ["List the texts on this page with their boxes.", "Write down each text and where it is.", "Read this page and give every text's place."],
    "actions": ["What can be done on this page?", "List the actions that this page offers.", "Name all controls and what they accept."],
    "locate": ["Where is {text}?", "Point to {text}.", "Find the box of {text}."],
    "describe": ["Describe this page.", "Say in a sentence what this page is for.", "Sum up what is shown."],
    "next": ["Which action leads to the second page?", "What was done between the two pages?", "Name the step from the first page to the next."],
}
OWN_LINE = ("actions", "describe", "next")


def task_instruction(task: str, seed: str, *keys: str) -> Column:
    """An instruction of the task's pool, by a hash of the keys."""
    pick = picked(POOLS[task], seed, *keys)
    return F.concat(F.lit("\n"), pick) if task in OWN_LINE else pick


def grounding_pairs(labels: DataFrame, key: str, seed: str, boxed: bool = True) -> DataFrame:
    """key, question, answer: for one labelled line of each page, chosen by hash, where its text stands.

    labels(key, line, label, box) as element_labels() gives them; lines without a text are not asked about.
    """
    named = labels.filter((F.coalesce("label", F.lit("")) != "") & F.col("box").isNotNull())
    order = F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), "line")).alias("h"), "line")
    one = named.groupBy(key).agg(F.min_by(F.struct("label", "box"), order).alias("v"))
    answer = F.concat(F.lit("<ref>"), "v.label", F.lit("</ref><box>"), "v.box", F.lit("</box>")) if boxed else F.concat("v.label", F.lit(", "), "v.box")
    return one.select(key, filled(task_instruction("locate", seed, key), F.col("v.label")).alias("question"), answer.alias("answer"))


def picked(pool: list[str], seed: str, *keys: str) -> Column:
    """One of the pool's templates, by a hash of the keys."""
    at = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, pool)), (F.pmod(at, F.lit(len(pool))) + 1).cast("int"))


def pair_instructions(pages: DataFrame, seed: str = "next") -> DataFrame:
    """parent, child, folder, instruction, action: a question for each page and the page that it was reached from, and the step between.

    pages(name): paths of segments, of which the last is the step; pages whose parent is not among them have no question. The
    folder is that of the child in the level layout.
    """
    name = F.col("name")
    known = pages.select("name").distinct()
    kids = known.filter(F.size(segments(name)) > 1).select(name.alias("child"), parent_name(name).alias("parent"), folder(name).alias("folder"), F.element_at(segments(name), -1).alias("action"))
    met = kids.join(known.withColumnRenamed("name", "parent"), "parent", "left_semi")
    return met.select("parent", "child", "folder", task_instruction("next", seed, "child").alias("instruction"), "action")


def filled(template: Column, text: Column) -> Column:
    """The template with {text} filled in."""
    return F.replace(template, F.lit("{text}"), text)


def running_mean(rows: DataFrame, value: str, seq: str | list[str], group: str) -> DataFrame:
    """rows with running: the mean of the value up to each row, in order, within a group. Decimals are summed exactly.

    Two levels: rows are dealt out in ranges of (group, seq), so a group of any size is on many tasks, and summed there; only
    the first group of a range can go on from ranges before it, so one row a range, with what its first group has had
    before, goes to all tasks.
    """
    order = [seq] if isinstance(seq, str) else list(seq)
    kind = rows.schema[value].dataType
    summed = F.col(value) if isinstance(kind, DecimalType) else F.col(value).cast("double")
    ranged = written(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_sum", F.sum(summed).over(own)).withColumn("_n", F.count(value).over(own))
    g = F.struct(F.col(group).alias("v")).alias("_g")  # in a struct null equals null, and comes first as in the ranges
    totals = ranged.groupBy("_range", g).agg(F.sum(summed).alias("_s"), F.count(value).alias("_c"))
    ends = totals.groupBy("_range").agg(F.min(F.struct("_g", "_s", "_c")).alias("lo"), F.max(F.struct("_g", "_s", "_c")).alias("hi"))
    both = ends.select("_range", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("e")).select("_range", "e.*")
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    had = both.select("_range", "_g", F.sum("_s").over(before).alias("_s0"), F.sum("_c").over(before).alias("_c0")).filter("_c0 is not null")
    met = local.withColumn("_g", g).join(F.broadcast(had), ["_range", "_g"], "left")
    # An empty sum is null, and so is the mean of no values.
    whole = F.when(F.col("_sum").isNull(), F.col("_s0")).when(F.col("_s0").isNull(), F.col("_sum")).otherwise(F.col("_sum") + F.col("_s0"))
    n = F.col("_n") + F.coalesce("_c0", F.lit(0))
    return met.withColumn("running", F.when(n > 0, whole / n)).select(*rows.columns, "running")


def totals_over(catalogue: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, total for every entry of the catalogue, zeros included."""
    sums = rows.groupBy(key).agg(F.sum(value).alias("total"))
    return catalogue.join(sums, key, "left").select(*catalogue.columns, F.coalesce("total", F.lit(0)).alias("total"))


def mentions(rows: DataFrame, key: str, text: str, names: DataFrame, name: str, longest: int = 8) -> DataFrame:
    """key, name: the names, none of which holds a blank, that the text of a row holds anywhere, inside words too.

    A name stands within a word, so names are looked for in the distinct words of all rows: a word and a name meet
    by a part of the word that is as long as the name, or as `longest`, and equals its end. What is left is joined
    to the rows by word. Null texts mention nothing; a name is given once for each row.
    """
    words = rows.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("word")).filter("word <> ''")
    wanted = names.select(F.col(name).alias("name")).filter("name <> ''").distinct()
    ends = wanted.withColumn("part", F.expr(f"right(name, {longest})"))
    sizes = [r[0] for r in ends.select(F.length("part")).distinct().collect()]  # longest at most
    spelt = lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - (n - 1)), lambda k: F.substring(F.col("word"), k, F.lit(n)))
    parts = F.concat(*[F.when(F.length("word") >= n, spelt(n)).otherwise(F.array().cast("array<string>")) for n in sizes]) if sizes else F.array().cast("array<string>")
    met = words.select("word").distinct().select("word", F.explode(F.array_distinct(parts)).alias("part")).join(ends, "part")
    held = met.filter(F.col("word").contains(F.col("name"))).select("word", "name").distinct()
    return words.join(held, "word").select(key, "name").distinct()
