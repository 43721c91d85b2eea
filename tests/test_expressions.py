from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import geometry as G
from corpusloom.functions import metrics as M
from corpusloom.functions import text as T
from corpusloom.operators import corpus, elements


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def box(*v):
    return G.box(*map(F.lit, v))


def test_iou(spark):
    r = one(spark, a=G.iou(box(0, 0, 10, 10), box(5, 5, 15, 15)), b=G.iou(box(0, 0, 1, 1), box(5, 5, 6, 6)), c=G.iou(box(3, 3, 3, 3), box(3, 3, 3, 3)), d=G.iou(box(0, 0, 1, 1), G.bounds(F.lit("none"))))
    assert (round(r.a, 6), r.b, r.c, r.d) == (0.142857, 0, 0, 0)


def test_boxes_from_text(spark):
    r = one(spark, a=G.bounds(F.lit("x [1,2][3,4]")), b=G.any_box(F.lit("(1,2),(3, 4)")), c=G.four_numbers(F.lit("1 2 3")), d=G.four_numbers(F.lit("a1b2c3d4")))
    assert tuple(r.a) == tuple(r.b) == tuple(r.d) == (1, 2, 3, 4) and r.c is None


def test_scrolls(spark):
    b = box(0, 0, 100, 200)
    r = one(
        spark, up=G.short_scroll(b, F.lit("up")), left=G.short_scroll(b, F.lit("left")), none=G.short_scroll(b, F.lit("in")),
        far=G.long_scroll(b, F.lit("down"), 720, 1280), back=G.inferred_scroll(G.short_scroll(b, F.lit("up"))),
    )
    assert tuple(r.up) == (50, 150, 50, 50) and tuple(r.left) == (75, 100, 25, 100) and r.none is None
    assert tuple(r.far) == (50, 10, 50, 1270) and r.back.direction == "up"


def test_halves_round_down_below_zero(spark):
    assert one(spark, h=G.halved(F.lit(-3))).h == -2


def test_tiles_prefer_more_of_them_for_large_images(spark):
    r = one(spark, a=G.tile_grid(F.lit(100), F.lit(100)), b=G.tile_grid(F.lit(2000), F.lit(2000)), c=G.tile_grid(F.lit(300), F.lit(100)))
    assert (tuple(r.a), tuple(r.b), tuple(r.c)) == ((1, 1), (2, 2), (3, 1))


@settings(max_examples=25, deadline=None)
@given(st.text("abcd é", max_size=12), st.text("abcd é", max_size=12))
def test_char_f1_is_the_multiset_f1(spark, a, b):
    n = sum((Counter(a) & Counter(b)).values())
    want = 2 * n / (len(a) + len(b)) if n else 0.0
    assert abs(one(spark, f=M.char_f1(F.lit(a), F.lit(b))).f - want) < 1e-12


def test_char_f1_markers_and_empty_predictions(spark):
    r = one(
        spark, a=M.char_f1(F.lit("abca"), F.lit("abcd")), m=M.char_f1(F.lit("x"), F.lit("no answer"), "no answer"),
        e=M.char_f1_or_inside(F.lit(""), F.lit("abc")), p=M.char_f1_or_inside(F.lit(""), F.lit("abc"), parity=True), i=M.char_f1_or_inside(F.lit("bc"), F.lit("abc")),
    )
    assert (r.a, r.m, r.e, r.p, r.i) == (0.75, 1.0, 0.0, 1.0, 1.0)


def test_token_f1(spark):
    r = one(spark, a=M.token_f1(F.lit("the red dog"), F.lit("a red cat"), ["the", "a"]), b=M.token_f1(F.lit("Red"), F.lit("bored"), []), c=M.token_f1(F.lit("the"), F.lit("cat"), ["the"]))
    assert (r.a, r.b, r.c) == (0.5, 1.0, 0.0)


def test_gestures(spark):
    g = lambda p, t: M.gesture_match(F.lit(p), F.lit(t), [])
    r = one(
        spark, near=g("click(<box>[10,10][1,1]</box>)", "click(<box>[20,20][9,9]</box>)"), far=g("click(<box>[10,10][1,1]</box>)", "click(<box>[300,20][9,9]</box>)"),
        way=g("scroll(<box>[1,2][3,4]</box>, up)", "scroll(<box>[5,2][3,4]</box>, up)"), done=g("click()", "STATUS_TASK_COMPLETE"), other=g("type(a)", "click(<box>[1,1][1,1]</box>)"),
    )
    assert (r.near, r.far, r.way, r.done, r.other) == (1.0, 0.0, 1.0, 1.0, 0.0)


def test_checks(spark):
    h = F.array(F.lit("open mail"), F.lit("press send"))
    lit = lambda *w: F.array(*map(F.lit, w))
    r = one(spark, any=M.check_passed(lit("x", "|", "mail"), h), all=M.check_passed(lit("mail", "&", "send"), h), par=M.check_passed(lit("mail", "&", "send"), h, parity=True), n=M.check_passed(lit("mail", "x"), h), cov=M.package_coverage(lit("mail", "x"), h))
    assert (tuple(r.any), tuple(r.all), tuple(r.par), tuple(r.n), r.cov) == ((1, 1), (1, 1), (0, 1), (1, 2), 0.5)


def test_formula_answers_keep_case_and_lose_spaces(spark):
    a = F.array(F.lit("X + y"))
    r = one(spark, f=M.contains_any(F.lit("so X+y"), a, True), p=M.contains_any(F.lit("so x + Y"), a), n=M.contains_any(F.lit("so x+y"), a, True))
    assert (r.f, r.p, r.n) == (1, 1, 0)


def test_lines_and_attributes(spark):
    line = F.lit('<p id="i" class="c" description="d"> hi </p>')
    r = one(spark, t=T.inner_text(line), d=T.attribute(line, "description"), n=T.attribute(line, "package"), l=T.lines(F.lit(" \na\nb\n ")), k=T.kept_lines(F.lit("a\n\nb")), e=T.all_chinese(F.lit("")), nb=T.stripped(F.lit(" x "), unicode=True))
    assert (r.t, r.d, r.n, r.l, r.k, r.e, r.nb) == ("hi", "d", None, ["a", "b"], ["a\n", "\n", "b"], True, "x")


def test_first_csv_name_loses_its_mark():
    assert T.first_column_without_mark(["﻿id", "q"]) == ["id", "q"]


def test_commands(spark):
    m = F.create_map(F.lit(1), F.lit('<p bounds="[0,0][100,200]"> a </p>'))
    c = lambda a: elements.command(F.lit(a), m, 720, 1280)
    r = one(spark, s=c("scroll(1,up)"), l=c("scroll(1,up, long)"), i=c("input(1,hey)"), x=c("click(7)"), k=c("click(1)"))
    assert r.s == "scroll(([50, 150], [50, 50]))" and r.l == "scroll(([50, 190], [50, 10]))"
    assert r.i == "input(<p bounds=\"[0,0][100,200]\"> a </p>, 'hey')" and r.x == "click()" and r.k.startswith("click(<p")


def test_action_spaces_and_sections(spark):
    r = one(spark, c=elements.action_space(F.lit('<p clickable="true"> go </p>'), F.lit("[1,2][3,4]")), i=elements.action_space(F.lit('<input class="x">  </input>'), F.lit(None).cast("string")), s=elements.action_space(F.lit('<div scrollable="true">  </div>'), F.lit("[1,2][3,4]")))
    assert r.c == ["click(<ref>go</ref><box>[1,2][3,4]</box>)"] and r.i == ["input()"] and len(r.s) == 4
    text = one(spark, t=elements.sections(F.array(F.lit("a")), F.array().cast("array<string>"), F.array(F.lit("s")))).t
    back = one(spark, m=elements.parsed_sections(F.lit(text), {"clickable:": "c", "inputs:": "i", "scrollable:": "s"})).m
    assert back == {"c": ["a"], "i": [], "s": ["s"]}


def test_keys(spark):
    r = one(spark, a=elements.key_of(F.lit("click(<p> Send </p>)")), b=elements.key_of(F.lit('input(<input description="name">  </input>, bob)')), c=elements.key_of(F.lit("click(<p> x </p>)")))
    assert tuple(r.a) == ("Send", "click") and tuple(r.b) == ("name", "bob") and r.c is None


def test_model_actions_with_and_without_parity(spark):
    labels = spark.createDataFrame([(1, '<p bounds="[1,2][3,4]"> Go </p>', "Go", "[1,2][3,4]")], "k long, line string, label string, box string")
    raw = spark.createDataFrame([(1, 'click(<p bounds="[1,2][3,4]"> Go </p>)')], "k long, action string")
    assert elements.to_model_action(raw, labels, "k").first().model == "click(<ref>Go</ref><box>[1,2][3,4]</box>)"
    assert elements.to_model_action(raw, labels, "k", parity=True).first().model is None


def test_chat_rows_mask_the_asker(spark):
    talk = [(1, [("system", "s"), ("user", "hi there"), ("assistant", "yes")])]
    df = spark.createDataFrame(talk, "id long, conversations array<struct<from:string,value:string>>")
    r = corpus.chat_rows(df, "id", 24, system="be").first()
    assert r.input[:6] == ["<s>", "system", "\n", "be", "<e>", "\n"] and len(r.input) == len(r.labels) == 24
    user = r.input.index("user")
    assert r.labels[user : user + 4] == [None] * 4 and r.labels[r.input.index("yes")] == "yes" and r.labels[r.input.index("assistant")] is None
    assert r.mask == [w != "<pad>" for w in r.input]
    assert len(corpus.chat_rows(df, "id", 5, system="be").first().input) == 5


def test_templates(spark):
    df = spark.range(50).select(corpus.filled(corpus.picked(["a {text}", "b {text}"], "s", "id"), F.lit("x")).alias("q"))
    assert {r.q for r in df.collect()} == {"a x", "b x"}


def test_names_summaries_and_prompts(spark):
    lit = lambda *w: F.array(*map(F.lit, w))
    r = one(
        spark, a=T.translated(F.lit("cat"), {"cat": "Katze"}), b=T.translated(F.lit("dog"), {"cat": "Katze"}), s=elements.summary(lit("name", " "), lit("go")),
        n=elements.summary(lit(" "), lit("")), p=elements.task_prompt(F.lit("buy"), lit('{"action_type": "TYPE", "typed_text": "x"}', "{}"), 412, 732),
        e=elements.task_prompt(F.lit("buy"), F.array().cast("array<string>"), 412, 732), d=elements.readdressed(F.lit("run -s a:1 x"), "a:1", "b:2"),
    )
    assert (r.a, r.b, r.s, r.n) == ("Katze", "dog", "Inputs: name. Clickable: go.", "No inputs. Nothing to click.")
    assert (r.p, r.e, r.d) == ("Task: buy\nDone so far:\ntype(x)", "Task: buy\nDone so far:\n", "run -s b:2 x")
