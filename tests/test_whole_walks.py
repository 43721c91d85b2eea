"""Paths of walks of many steps: every event has its path, in each query made of paths."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.plans import catalog

KINDS = ["view", "click", "error", "login", "purchase"]


@pytest.fixture(scope="module")
def walks():
    """event_id, user_id, event_type: 23, 9, 7 and 1 events of four users, in mixed order."""
    users = [u for i in range(23) for u, n in ((1, 23), (2, 9), (3, 7), (40, 1)) if i < n]
    return [(i, u, KINDS[(i * i + u) % 5]) for i, u in enumerate(users)]


@pytest.fixture(scope="module")
def walk_dir(spark, walks, tmp_path_factory):
    top = tmp_path_factory.mktemp("walks")
    spark.createDataFrame(walks, "event_id long, user_id long, event_type string").orderBy(F.rand(1)).write.parquet(f"{top}/events.parquet")
    return str(top)


@pytest.fixture(scope="module")
def names(walks):
    """user_id, event_id, name in plain Python."""
    so_far, out = {}, []
    for i, u, kind in walks:
        so_far[u] = so_far.get(u, f"app{u}0") + "_" + kind
        out.append((u, i, so_far[u]))
    return out


def test_every_event_has_a_path(spark, walk_dir, names):
    rows = catalog.QUERIES["path_names"](spark, walk_dir).collect()
    assert sorted((r.user_id, r.event_id, r.name) for r in rows) == sorted(names)
    assert all((r.parent, r.depth) == (r.name.rpartition("_")[0], r.name.count("_") + 1) and r.folder == r.parent.replace("_", "/") for r in rows)
    assert catalog.QUERIES["depth_sum"](spark, walk_dir).first() == (40, sum(n.count("_") for _, _, n in names))
    assert catalog.QUERIES["next_free_index"](spark, walk_dir).first().next_index == 41


def test_counts_and_actions_of_every_event(spark, walk_dir, names):
    counts, kids = {}, {}
    have = {n for _, _, n in names}
    for _, _, n in names:
        prefix = "_".join(n.split("_")[:2])
        counts[prefix] = counts.get(prefix, 0) + 1
        parent, _, action = n.rpartition("_")
        if parent in have:
            kids.setdefault(parent, set()).add(action)
    assert dict(map(tuple, catalog.QUERIES["prefix_counts"](spark, walk_dir).collect())) == counts
    assert dict(map(tuple, catalog.QUERIES["actions_from_names"](spark, walk_dir).collect())) == {n: ",".join(sorted(a)) for n, a in kids.items()}


def test_holds_reach_every_event(spark, walk_dir, names):
    pages = {}
    for _, i, n in names:
        pages[n] = min(pages.get(n, i), i)
    holds = [(n, i) for n, i in pages.items() if i % 5 == 0]
    want = [(i, n, any(i >= since and (n == h or n.startswith(h + "_")) for h, since in holds)) for n, i in pages.items()]
    assert sorted(map(tuple, catalog.QUERIES["flag_hold_prefix"](spark, walk_dir).collect())) == sorted(want)


def test_first_steps_where_asked_for(spark, walk_dir, names):
    got = graph.cumulative_paths(spark.read.parquet(f"{walk_dir}/events.parquet"), "user_id", "event_type", "event_id", 2)
    assert sorted(map(tuple, got.collect())) == sorted(n for n in names if n[2].count("_") <= 2)
