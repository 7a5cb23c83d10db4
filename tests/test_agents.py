"""Descendants, spawn calls with several children, edges and their certainty."""

import re

from pyspark.sql import functions as F

from quern.operators import agents as A

SESSIONS = "id string, parent_id string, agent_id string, agent_path string, agent_type string"
CALLS = "session string, call_id string, message_id string, result_id string, ordinal long, input string, output string, status string"


def test_edges_of_one_parent(spark):
    headers = spark.createDataFrame([("p", None, None, None, None), ("s#a", "p", "A-7", "/z", "t"), ("s#b", "p", None, "/a", None), ("s#c", None, None, "/m", None), ("s#d", "", None, None, None), ("lone", "gone", None, None, None)], SESSIONS)
    registry = spark.createDataFrame([("s#c", "p", "closed"), ("s#d", "p", "open"), ("s#a", "other", "open")], "child string, parent string, status string")
    calls = spark.createDataFrame([
        ("p", "k1", "m1", "r1", 1, '{"prompt":"go"}', "started A-7 and /a", "completed"),
        ("p", "k2", "m2", None, 2, '{"prompt":"b again: /a"}', None, None),
        ("p", "k3", "m3", None, 3, '{"prompt":"nobody"}', None, "queued"),
        ("p", "k4", "m4", None, 4, '{"prompt":"/z too"}', None, "odd"),
    ], CALLS)
    edges, losses = A.session_edges(A.parents(headers, registry), calls, registry)
    got = [(r.ordinal, r.child_session_id, r.source_call_id, r.association, r.confidence, r.status, r.prompt) for r in edges.orderBy("ordinal").collect()]
    # k1 names a and b: b is listed first (by path); k2 names b only, which is taken; k4 takes a
    assert got == [
        (1, "s#b", "k1", "spawn-call", 1.0, "closed", "go"),
        (2, "s#a", "k4", "spawn-call", 1.0, "open", "/z too"),
        (3, "s#d", None, "sqlite-parent", 0.95, "open", ""),
        (4, "s#c", None, "sqlite-parent", 0.95, "closed", ""),
    ]
    assert sorted((r.code, r.detail) for r in losses.collect()) == [("session.subagent_unlinked", "s#c"), ("session.subagent_unlinked", "s#d")]
    assert A.session_edges(A.parents(headers, registry).limit(0), calls, registry)[0].collect() == []


def test_a_call_may_name_many_children(spark):
    calls = spark.createDataFrame([("p", f"k{k}", f"<{k}><{k + 1}><{k + 2}>", k) for k in range(60)], "parent string, call_id string, haystack string, ordinal long")
    children = spark.createDataFrame([("p", f"c{k}", f"<{k}>", 100 - k) for k in range(60)], "parent string, child string, identity string, ordinal long")
    left, want = set(range(60)), set()
    for k in range(60):
        options = [c for c in (k + 2, k + 1, k) if c in left]  # later children are listed first
        if options:
            left.remove(options[0])
            want.add((f"k{k}", f"c{options[0]}"))
    assert {(r.call_id, r.child) for r in A.spawn_matches(calls, children).collect()} == want


def test_identities_are_found_wherever_they_stand(spark):
    texts = spark.createDataFrame([("x", 1, "abcdefghij"), ("x", 2, "hij"), ("y", 3, "abcdefghij"), ("x", 4, None), ("x", 5, "zabcdefghz")], "key string, n int, text string")
    names = spark.createDataFrame([("x", "a", "abcdefgh"), ("x", "b", "hij"), ("x", "c", "j"), ("x", "d", "abcdefghijk"), ("x", "e", ""), ("y", "f", "bcdefghij"), ("x", "a2", "abcdefgh")], "key string, name string, identity string")
    got = {(r.n, r.name) for r in A.containing(texts, names, "key", "text", "identity").collect()}
    assert got == {(1, "a"), (1, "a2"), (1, "b"), (1, "c"), (2, "b"), (2, "c"), (3, "f"), (5, "a"), (5, "a2")}
    assert A.containing(texts, names.limit(0), "key", "text", "identity").collect() == []


def test_thousands_of_calls_and_children_of_one_parent(spark):
    k = F.col("id").cast("string")
    n = spark.range(5000).select("id", F.lit("p").alias("parent"), F.concat(F.lit("019a-7f3c-"), F.lpad(k, 6, "0")).alias("name"))
    calls = n.select("parent", F.concat(F.lit("k"), "id").alias("call_id"), F.concat(F.lit("started agent "), "name", F.lit(" now")).alias("haystack"), F.col("id").alias("ordinal"))
    children = n.select("parent", F.concat(F.lit("c"), "id").alias("child"), F.col("name").alias("identity"), (-F.col("id")).alias("ordinal"))
    got = A.spawn_matches(calls, children)
    assert got.count() == 5000 and got.where("substring(call_id, 2) <> substring(child, 2)").isEmpty()


def test_descendants_of_nested_roots_and_long_chains(spark):
    chain = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    roots = spark.createDataFrame([("0",), ("4990",), ("4995",), ("none",)], "id string")
    got = A.descendants(chain, roots).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in got} == {"0": 5000, "4990": 10, "4995": 5}
    circle = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "id string, parent_id string")
    assert {(r.root, r.id) for r in A.descendants(circle, spark.createDataFrame([("a",)], "id string")).collect()} == {("a", "a"), ("a", "b"), ("a", "c")}


def test_no_table_of_sessions_is_broadcast(spark):
    headers = spark.createDataFrame([("p", None, None, None, None), ("s#a", "p", "A-7", "/z", "t"), ("s#b", None, None, "/a", None)], SESSIONS)
    registry = spark.createDataFrame([("s#b", "p", "closed")], "child string, parent string, status string")
    calls = spark.createDataFrame([("p", "k1", "m1", "r1", 1, '{"prompt":"go"}', "started A-7 and /a", "completed")], CALLS)
    edges, losses = A.session_edges(A.parents(headers, registry), calls, registry)
    names = headers.select(F.lit("p").alias("parent"), F.col("agent_path").alias("identity"), F.col("id").alias("child"))
    found = A.containing(calls.select(F.lit("p").alias("parent"), "output"), names, "parent", "output", "identity")
    assert [r.child for r in found.collect()] == ["s#b"]
    for df in (edges, losses, found):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_texts_are_not_sorted(spark):
    texts = spark.createDataFrame([("p", "started /agents/01 and /agents/02"), ("q", "started /agents/01"), (None, "/agents/01"), ("p", None)], "parent string, output string")
    names = spark.createDataFrame([("p", "/agents/01", "a"), ("p", "/agents/02", "b"), ("p", "02", "c"), ("q", "/agents/02", "d"), (None, "/agents/01", "e"), ("p", "", "f")], "parent string, identity string, child string")
    found = A.containing(texts, names, "parent", "output", "identity")
    assert sorted((r.parent, r.child) for r in found.collect()) == [("p", "a"), ("p", "b"), ("p", "c")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [_gram" in plan and not re.search(r"Sort \[(\w+#\d+L? ASC NULLS FIRST, )?_gram#", plan)
