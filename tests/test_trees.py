"""Folds over trees against plain walks: deep chains, wide nodes, cycles, repeated rows."""

import random

from pyspark.sql import functions as F

from quern.operators import topology as G

SCHEMA = "id string, parent_id string, count long, size long, updated long, tokens long"


def walk(rows):
    """The forest by walking up from every node: parent, root and depth by id."""
    parent = {i: p if p in {r[0] for r in rows} and p != i else None for i, p, *_ in rows}
    cyclic = set()
    for i in parent:
        path, at = [], i
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is not None:
            cyclic.update(path[path.index(at) :])
    parent = {i: None if i in cyclic else p for i, p in parent.items()}
    out = {}
    for i in parent:
        at, depth = i, 0
        while parent[at] is not None:
            at, depth = parent[at], depth + 1
        out[i] = (parent[i], at, depth)
    return out


def forest_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        up = None if k == 0 or rng.random() < 0.05 else f"n{rng.randrange(max(0, k - 6), k)}"
        rows.append((f"n{k}", up, rng.randrange(5), rng.randrange(100), rng.randrange(1000), k))
    rows += [("c1", "c2", 1, 1, 5, 0), ("c2", "c3", 1, 1, 9, 0), ("c3", "c1", 1, 1, 2, 0), ("d", "c2", 1, 1, 1, 0), ("e", "d", 1, 1, 1, 0), ("self", "self", 1, 1, 1, 0), ("lost", "gone", 1, 1, 1, 0)]
    return rows


def test_forest_and_rollup_match_a_walk(spark):
    rows = forest_rows(120, 3)
    nodes = spark.createDataFrame(rows, SCHEMA)
    want = walk(rows)
    got = {r.node: (r.parent, r.top, r.depth) for r in G.forest(nodes).collect()}
    assert got == want
    by = {r[0]: r for r in rows}
    below = {i: [] for i in by}
    for i in by:
        at = i
        while at is not None:
            below[at].append(by[i])
            at = want[at][0]
    folded = {r.id: (r["count"], r.size, r.updated, r.tree_count, r.child_count, r.tokens) for r in G.rollup(nodes).collect()}
    assert folded == {i: (sum(x[2] for x in t), sum(x[3] for x in t), max(x[4] for x in t), len(t), sum(want[x[0]][0] == i for x in t), by[i][5]) for i, t in below.items()}
    assert {r.id for r in G.roots(nodes).collect()} == {i for i, (p, _, _) in want.items() if p is None}


def test_repeated_rows_and_empty_tables(spark):
    nodes = spark.createDataFrame([("a", None, 1, 1, 1, 0), ("b", "a", 1, 1, 1, 0), ("b", "a", 1, 1, 1, 0), (None, "a", 1, 1, 1, 0)], SCHEMA)
    assert sorted((r.node, r.parent) for r in G.forest(nodes).collect()) == [("a", None), ("b", "a")]
    assert G.forest(nodes.limit(0)).collect() == [] and G.rollup(nodes.limit(0)).collect() == []


def test_a_chain_of_a_hundred_thousand(spark):
    n = 100_000
    k = F.col("id").cast("long")
    chain = spark.range(n).select(k.alias("id"), F.when(k > 0, k - 1).alias("parent_id"), F.lit(1).cast("long").alias("count"), F.lit(2).cast("long").alias("size"), k.alias("updated"), F.lit(0).alias("tokens"))
    out = G.rollup(chain).where("id in (0, 1, 99999)").orderBy("id").collect()
    assert [(r.id, r["count"], r.size, r.updated, r.child_count) for r in out] == [(0, n, 2 * n, n - 1, 1), (1, n - 1, 2 * n - 2, n - 1, 1), (n - 1, 1, 2, n - 1, 0)]


def test_ways_settle_behind_hidden_nodes(spark):
    hops = [(f"h{k}", f"h{k - 1}" if k else "seen") for k in range(40)] + [("x", None), ("y", "x"), ("p", "q"), ("q", "p"), ("r", "q"), ("u", "unknown")]
    got = {r.node: r.up for r in G.settled(spark.createDataFrame(hops, "node string, up string")).collect()}
    assert got == {f"h{k}": "seen" for k in range(40)} | {"x": None, "y": None, "p": None, "q": None, "r": None, "u": "unknown"}


def test_survivors_hang_on_the_nearest_survivor(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None, k) for k in range(60)] + [("z", "gone", 1)]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, v int")
    removed = spark.createDataFrame([(f"n{k}",) for k in range(60) if k % 20 and k != 59], "id string")
    assert {r.id: (r.parent_id, r.v) for r in G.relinked(nodes, removed).collect()} == {"n0": (None, 0), "n20": ("n0", 20), "n40": ("n20", 40), "n59": ("n40", 59), "z": (None, 1)}
