"""Streams of several batches, and rows that have nothing to compare."""

from pyspark.sql import functions as F

from corpusloom.operators import canonical, uitree
from corpusloom.sources import files
from corpusloom.streaming import upsert


def test_tables_of_many_batches_equal_those_of_one(spark, tmp_path):
    kinds = ["view", "click", "error", "login", "purchase"]
    rows = [(i, 1 + i * 7 % 4, kinds[(i * i + i // 3) % 5], float(i % 9)) for i in range(90)]
    log = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    for k in range(3):
        log.filter(F.floor(F.col("event_id") / 30) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = upsert.upkeep(stream, f"{tmp_path}/out", upsert.walks_of_batches)
    last, edges, flags, pages, canon = {}, {}, {}, {}, {}
    for i, u, kind, v in rows:
        if u in last:
            n, first = edges.get((last[u], kind), (0, i))
            edges[last[u], kind] = n + 1, first
        last[u] = kind
        flags[u, kind] = i, v
        pages.setdefault((u, kind), i)
        canon.setdefault(kind, i)
    assert {(r.src, r.dst): (r.steps, r.first_seq) for r in made["edges"].collect()} == edges
    assert {(r.user_id, r.node): (r.last_seq, r.flag) for r in made["frontier"].collect()} == flags
    assert {(r.user_id, r.node): r.page_id for r in made["pages"].collect()} == pages
    assert {r.node: r.unique_id for r in made["canonical"].collect()} == canon
    assert {r.user_id: r.node for r in made["walkers"].collect()} == last


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = upsert.upsert_to(path, ["k"], "seq")
    merge(spark.createDataFrame([(f"k{i}", 1, "old") for i in range(200)], "k string, seq long, v string"), 0)
    merge(spark.createDataFrame([("k7", 2, "new")], "k string, seq long, v string"), 1)
    assert spark.read.parquet(f"{path}/data/batch-1-0").count() == 1
    got = {r.k: (r.seq, r.v) for r in upsert.latest(spark, path).collect()}
    assert len(got) == 200 and got["k7"] == (2, "new") and got["k8"] == (1, "old")


def test_runs_are_merged_in_levels_and_old_ones_go(spark, tmp_path):
    path = str(tmp_path / "t")
    want = {}
    for b in range(21):
        rows = [(f"k{(b * 3 + i) % 11}", b) for i in range(4)]
        for again in range(1 + (b == 9)):  # a batch that runs again writes the same
            upsert.merge_rows(path, b, spark.createDataFrame(rows, "k string, n long"), ["k"], {"n": "sum"})
        for k, n in rows:
            want[k] = want.get(k, 0) + n
    assert {r.k: r.n for r in upsert.latest(spark, path).collect()} == want
    assert len(list((tmp_path / "t/data").iterdir())) <= 2 * 3 * upsert.FAN and len(list((tmp_path / "t/manifest").glob("batch=*"))) == 2
    assert sorted(level for _, level in upsert._manifest(spark, path)["runs"]) == [0, 1, 2]


def test_pages_that_cannot_be_parsed_keep_their_pairs(spark):
    pages = spark.createDataFrame([(0, "<a><b/><c><d/></c></a>"), (1, "<a"), (2, "<a><b><e/><f/></b></a>"), (3, None)], "page_id long, xml string")
    nodes = uitree.parsed(pages, "page_id", "xml")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (0, 2)], "a long, b long")
    got = {(r.a, r.b): (r.unmatched, r.difference) for r in uitree.tree_difference(pairs, nodes, "page_id").collect()}
    assert got == {(0, 1): (4, 2.0), (0, 2): (4, 1.0), (1, 3): (0, 0.0)}
    delta = lambda stop: {(r.a, r.b): r.delta for r in uitree.child_count_delta(pairs, nodes, "page_id", stop).collect()}
    assert delta(None) == {(0, 1): 0, (0, 2): 3, (1, 3): 0}
    assert delta(1) == {(0, 1): 0, (0, 2): 1, (1, 3): 0}


def plain_online(pages, limit):
    """Canonical pages by comparing with the parent, then with the best canonical page by BM25."""
    import math

    out, canon = {}, []
    for i, parent, lines in pages:
        alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) > limit if set(a) | set(b) else False
        known = {p: ls for p, _, ls in pages}
        if parent in out and alike(lines, known[parent]):
            out[i] = out[parent]
            continue
        scores = []
        mean = sum(len(known[c]) for c in canon) / len(canon) if canon else 0
        for c in canon:
            s = 0.0
            for term in lines:
                df = sum(term in known[d] for d in canon)
                f = known[c].count(term)
                s += math.log((len(canon) - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(known[c]) / (mean or 1)))
            scores.append((-round(s, 9), canon.index(c), c))
        best = min(scores)[2] if scores else None
        out[i] = best if best is not None and alike(lines, known[best]) else i
        if out[i] == i:
            canon.append(i)
    return out


def test_canonical_pages_equal_a_plain_pass(spark):
    import random

    rng = random.Random(3)
    pages = []
    for i in range(60):
        base = [f"l{rng.randrange(12)}" for _ in range(rng.randrange(0, 9))]
        if pages and rng.random() < 0.5:
            base = [x for x in rng.choice(pages)[2] if rng.random() < 0.85] + base[:1]
        pages.append((i, rng.randrange(i) if i and rng.random() < 0.6 else None, base))
    df = spark.createDataFrame([("app", i, p, i, ls, None) for i, p, ls in pages], "app string, page_id long, parent_id long, seq long, lines array<string>, image array<int>")
    got = {r.page_id: r.unique_id for r in canonical.online(df, "app").collect()}
    assert got == plain_online(pages, 0.5)
    held = {}
    canon = []
    for i, _, ls in pages:
        fits = [c for c in canon if ls and sum(x in set(dict((p, q) for p, _, q in pages)[c]) for x in ls) / len(ls) > 0.9]
        held[i] = fits[0] if fits else i
        canon += [] if fits else [i]
    assert {r.page_id: r.unique_id for r in canonical.offline(df, "app").collect()} == held


def test_canonical_pages_of_unknown_text(spark):
    df = spark.createDataFrame([("a", 1, None, 1, None, None), ("a", 2, 1, 2, ["x"], None), ("a", 3, 1, 3, ["x", None], None), ("a", 4, None, 4, [], None)], "app string, page_id long, parent_id long, seq long, lines array<string>, image array<int>")
    assert {r.page_id: r.unique_id for r in canonical.online(df, "app").collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    assert {r.page_id: r.unique_id for r in canonical.offline(df, "app").collect()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_catalogues_and_images(spark):
    rows = spark.createDataFrame([(0, "m", "p", "usr"), (1, "m", "q", "system"), (2, "n", "q", "usr"), (3, None, None, "usr")], "ord int, name string, package string, mode string")
    assert sorted((r.name, r.ord) for r in files.first_by(rows, "name", "ord").collect()) == [("m", 0), ("n", 2)]
    assert sorted((r.package, r.ord) for r in files.first_by(rows, "package", "ord").collect()) == [("p", 0), ("q", 1)]
    assert files.of_mode(rows, "usr").count() == 3 and files.of_mode(rows, "none").count() == 0
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (70000).to_bytes(4, "big")
    gif = b"GIF89a" + (300).to_bytes(2, "little") + (2).to_bytes(2, "little")
    got = spark.createDataFrame([(png,), (gif,), (b"xx",), (None,)], "c binary").select(files.image_size(F.col("c")).alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in got] == [(640, 70000), (300, 2), None, None]


def plain_offline(pages, above, last):
    """The ordered pass over one app's pages: page, lines."""
    out, canon, lines_of = {}, [], dict(pages)
    for i, lines in pages:
        fits = [c for c in canon if lines and sum(x in set(lines_of[c]) for x in lines) / len(lines) > above]
        out[i] = (fits[-1] if last else fits[0]) if fits else i
        canon += [] if fits else [i]
    return out


def test_pages_settled_in_rounds_equal_the_ordered_pass(spark, monkeypatch):
    import random

    from corpusloom.operators import containment

    rng = random.Random(12)
    rows, want = [], {False: {}, True: {}}
    for app in ("a", "b", None):
        pages = []
        for i in range(70):
            lines = [f"l{rng.randrange(25)}" for _ in range(rng.randrange(0, 14))]
            if pages and rng.random() < 0.6:
                lines = list(rng.choice(pages)[1])
                lines = lines if rng.random() < 0.5 else lines + [f"l{rng.randrange(40)}" for _ in range(rng.randrange(3))]
                rng.shuffle(lines)
            pages.append((i, lines))
        rows += [(app, i, i // 3, lines) for i, lines in pages]
        for last in want:
            want[last] |= {(app, i): u for i, u in plain_offline(pages, 0.7, last).items()}
    df = spark.createDataFrame(rows, "app string, page_id long, seq long, lines array<string>").repartition(5)
    for hot in (1000, 2):
        monkeypatch.setattr(containment, "HOT", hot)
        for last in want:
            got, rounds = containment.canonical_of(df, "app", 0.7, last)
            assert {(r.app, r.page_id): r.unique_id for r in got.collect()} == want[last]
            assert 1 < rounds < 12
    assert canonical.offline(df.filter("false"), "app").count() == 0


def test_pages_that_hold_all_later_ones(spark):
    from corpusloom.operators.containment import canonical_of

    pages = [(i, [f"x{k}" for k in range(i, 60)]) for i in range(12)]
    rows = [("a", i, i, lines) for i, lines in pages]
    got, _ = canonical_of(spark.createDataFrame(rows, "app string, page_id long, seq long, lines array<string>"), "app", 0.9)
    assert {r.page_id: r.unique_id for r in got.collect()} == plain_offline(pages, 0.9, False) == {i: 0 for i in range(12)}
