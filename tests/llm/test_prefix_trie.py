"""The prefix trie against its SQL and against a plain trie in Python."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from corpusloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, node long, depth int, parent long, place int, key string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "k", 5) for r in rows], SCHEMA).repartition(3)


def plain(rows):
    """The contract, conversation by conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = []
    for path, held in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode().split()) for p in under if p)
        ends = ",".join(str(c) for c in sorted(c for c in held if len(whole[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(held), len(path), parent, len(held), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def conversations():
    rows = []
    for c in range(60):
        for t in range(c % 6):
            rows.append((c, t, ["user", None, "assistant"][t % 3], f"turn {t} of {c % 3}" if t else "hello there"))
    rows += [(c, t, "user", f"long {t}") for c in (200, 220, 240) for t in range(12)]  # equal to the end
    rows += [(260, t, "user", f"long {t}" if t < 9 else "other") for t in range(12)]
    rows += [(7, None, "user", "first"), (8, 1, "user", "tie b"), (8, 1, "user", "tie a"), (9, 1, "same", "x"), (9, 1, "same", "x")]
    rows += [(None, 0, "user", "nobody"), (61, 0, None, None), (62, 0, "", ""), (-5, 0, "user", "below"), (-20, 1, "user", "base"), (101, 0, "u", "gone")]
    rows += [(80, 0, "ab", "c"), (300, 0, "a", "bc"), (320, 0, "user", " \t word\x0bword\xa0word ")]
    return rows


def test_equals_a_plain_trie(spark):
    rows = conversations()
    assert rows_of(prefix_trie.report(table(spark, rows))) == plain(rows)


def test_pieces_of_a_large_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(20 * c, 0, "user", "all the same") for c in range(300)]
    got = rows_of(prefix_trie.report(table(spark, rows)))
    assert got == plain(rows)
    assert len(got) == 2


def test_only_turnless(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # its head comes from 20, which is not there
    rows = [(c, 0, "user", "lost")]
    assert rows_of(prefix_trie.report(table(spark, rows))) == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty_table(spark):
    got = prefix_trie.report(table(spark, []))
    assert got.columns == COLUMNS
    assert got.count() == 0


@pytest.mark.parametrize("given", ["table", "rows"])
def test_equals_sql(spark, sf_dir, given):
    con = duckdb.connect()
    if given == "table":
        con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
        got = queries.op13_prefix_trie(spark, sf_dir)
    else:
        held = table(spark, conversations())
        frame = held.select("conv_id", "turn", "role", "text").toPandas()
        frame[["conv_id", "turn"]] = frame[["conv_id", "turn"]].astype("Int64")
        con.register("conversations", frame)
        got = prefix_trie.report(held)
    want = con.execute(f"select {', '.join(COLUMNS)} from ({queries.ORACLE_SQL['op13_prefix_trie']})").fetchall()
    assert rows_of(got) == sorted(want, key=str)
