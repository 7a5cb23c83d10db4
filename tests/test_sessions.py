"""Session search, records and scalars on small made-up tables."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import scalars as X
from quern.functions import validation as V
from quern.operators import library as L
from quern.operators import migration as K
from quern.operators import records as R
from quern.operators import sessions as C


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def found(spark):
    sessions = [("a", "pi", "Alpha beta", "/W", "m", 3, 10, 2), ("b", "codex", "none", "/v", "m", 2, 10, 1), ("c", "pi", "none", None, None, 1, 10, 2), ("d", "pi", "beta", "/w", "m", 4, 10, 0)]
    said = [("a", 1, "user", "alpha beta"), ("a", 2, "assistant", "gamma"), ("b", 1, "user", "alpha"), ("c", 1, "user", "beta alpha alpha"), ("c", 2, "user", "beta")]
    s = spark.createDataFrame(sessions, "session string, tool string, title string, dir string, model string, updated long, size long, count long")
    return s, spark.createDataFrame(said, "session string, message long, role string, text string")


def test_terms_meet_in_one_message_and_groups_rank(found):
    out = C.search_sessions(*found, "alpha beta").orderBy("place").collect()
    assert [(r.session, r.matched_in, r.content_match_count) for r in out] == [("a", ["metadata", "content"], 1), ("c", ["content"], 1)]
    assert out[0].total_matches == 2 and not out[0].has_more and out[1].rows[0].message == 1
    both = C.search_sessions(*found, "gamma", ["beta"]).orderBy("place").collect()
    assert [(r.session, r.content_match_count) for r in both][0] == ("a", 2) and {r.session for r in both} == {"a", "c", "d"}
    assert [r.session for r in C.search_sessions(*found, "beta", scope="metadata").orderBy("place").collect()] == ["d", "a"]
    assert [r.session for r in C.search_sessions(*found).orderBy("place").collect()] == ["d", "a", "b", "c"]


def test_limits_filters_and_refusals(found):
    page = C.search_sessions(*found, limit=2).collect()
    assert len(page) == 2 and page[0].total_matches == 4 and page[0].has_more
    assert [r.session for r in C.search_sessions(*found, projects=["/w"], end=3).collect()] == ["a"]
    assert C.search_sessions(*found, budget=1).count() == 0
    assert [r.session for r in C.search_sessions(*found, regex=r"alpha\b.*alpha", scope="content").collect()] == ["c"]
    for bad in ({"scope": "content"}, {"scope": "x"}, {"limit": 0}, {"limit": True}, {"agents": [1]}, {"more": ["x"] * 17}, {"query": "q", "regex": "r"}):
        with pytest.raises(ValueError):
            C.search_sessions(*found, **bad)


def test_times_and_shapes():
    assert V.time_ms("now-2d", 10**9) == 10**9 - 172_800_000 and V.time_ms("-1h", 7_200_000) == 3_600_000 and V.time_ms("now", 5) == 5
    assert V.time_ms("1970-01-01T00:00:01Z", 0) == 1000 == V.time_ms("1000", 0) and V.time_ms(None, 0) is None
    for bad in ("", "soon", True):
        with pytest.raises(ValueError):
            V.time_ms(bad, 0)
    V.json_shape({"a": [1, None, "x", {"b": True}]})
    deep = value = []
    for _ in range(9):
        value.append([])
        value = value[0]
    for bad in (deep, [0] * 2001, {"k" * 129: 1}, float("nan"), {1}):
        with pytest.raises(ValueError):
            V.json_shape(bad)


def test_bytes_are_clipped_between_characters(spark):
    df = spark.createDataFrame([("aé",), ("日本",), ("ab",), ("",)], "t string")
    clip, cut = X.byte_clip(F.col("t"), 2)
    assert [tuple(r) for r in df.select(clip, cut).collect()] == [("a", True), ("", True), ("ab", False), ("", False)]


def test_revisions_are_those_of_sorted_compact_json(spark):
    import hashlib

    cases = [("pi", "/ü/日/😀", 5, None), ("x", 'a"b\\', None, 7)]
    df = spark.createDataFrame(cases, "tool string, ref string, updated long, size long")
    got = [r[0] for r in df.select(X.revision(F.col("tool"), F.col("ref"), F.col("updated"), F.col("size"))).collect()]
    want = [json.dumps({"tool": t, "ref": r, "updated": u, "size": s, "file_identity": None}, sort_keys=True, separators=(",", ":")) for t, r, u, s in cases]
    assert got == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_json_is_bounded(spark):
    deep = "[" * 12 + "]" * 12
    df = spark.createDataFrame([('{"b":1,"a":[1,2]}',), (deep,), (json.dumps(list(range(300))),), (json.dumps("x" * 50_000),), (None,)], "j string")
    a, b, c, d, e = [r[0] for r in df.select(X.bounded_json(F.col("j"))).collect()]
    assert a == '{"a": [1, 2], "b": 1}' and json.loads(b)["truncated"] and len(json.loads(c)["value"]) == 200 and e is None
    assert set(json.loads(d)) == {"truncated", "sha256", "preview"} and len(json.loads(d)["preview"]) == 4000


def test_metadata_patches_drop_what_is_empty(spark):
    df = spark.createDataFrame([({"a": "1", "b": '"x"', "c": "true"}, {"b": '""', "c": "false", "d": "[1]", "e": "0"})], "o map<string,string>, p map<string,string>")
    assert df.select(X.merged_metadata(F.col("o"), F.col("p"))).first()[0] == {"a": "1", "d": "[1]"}


def test_numbers_flags_and_quotes(spark):
    df = spark.createDataFrame([("7.9", "TRUE", "it's"), ("-2.5", "x", "ok"), ("n", None, ""), ("9007199254740993", None, ""), ("-9223372036854775808", None, ""), ("1e3", None, ""), ("99999999999999999999", None, "")], "n string, b string, d string")
    got = df.select(X.to_int(F.col("n")), X.to_bool(F.col("b")), X.in_workdir(F.lit("ls"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(7, True, "cd 'it'\"'\"'s' && ls"), (-2, None, "cd ok && ls"), (None, None, "ls"), (9007199254740993, None, "ls"), (-(2**63), None, "ls"), (1000, None, "ls"), (None, None, "ls")]


def test_strict_trees_refuse_what_is_wrong(spark):
    nodes = lambda *x: spark.createDataFrame(list(x), "id string, parent_id string")
    none = nodes(("zz", None)).limit(0)
    got = K.strict_closure(nodes(("r", None), ("a", "r"), ("b", None)), nodes(("b", "a")))
    assert {(r.root, r.node) for r in got.collect()} == {("r", "r"), ("r", "a"), ("r", "b")} and got.select("digest").distinct().count() == 1
    for bad, registry in ((nodes(("a", None), ("a", None)), none), (nodes(("a", "x")), none), (nodes(("r", None), ("a", "b"), ("b", "a")), none), (nodes(("r", None), ("q", None), ("a", "r")), nodes(("a", "q")))):
        with pytest.raises(ValueError):
            K.strict_closure(bad, registry)


def test_deltas_apply_in_order(spark):
    view = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    up, gone = view.where("k = 2").withColumn("v", F.lit("c")), view.where("k = 1").select("k")
    assert rows(R.applied(view, up, gone, ["k"], 3, 4)) == [(2, "c")] and R.applied(view, up, gone, ["k"], 4, 4) is view
    with pytest.raises(ValueError):
        R.applied(view, up, gone, ["k"], 3, 6)


def test_plans_expire_and_are_audited(spark):
    plans = spark.createDataFrame([(1, "planned", 0, 0), (2, "planned", 900_000, 0), (3, "applied", 0, 0)], "plan_id int, status string, created_at long, updated_at long")
    assert [r.status for r in R.expired(plans, 1_000_000).orderBy("plan_id").collect()] == ["expired", "planned", "applied"]
    done = spark.createDataFrame([(3, "succeeded"), (3, "failed")], "plan_id int, outcome string")
    assert rows(R.audit(plans, done), "plan_id", "succeeded", "failed") == [(1, 0, 0), (2, 0, 0), (3, 1, 1)]


def test_all_rows_of_a_library_have_their_place(spark):
    rows = [(k * 7 % 1000, None if k % 50 == 0 else k % 90) for k in range(1000)] + [(None, 3), (None, None)]
    placed = L.placed(spark.createDataFrame(rows, "id long, at long").repartition(5), [F.desc_nulls_last("at"), F.asc_nulls_last("id")])
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is None, r[0]))
    assert [(r.id, r.at, r.place) for r in placed.orderBy("place").collect()] == [(*r, n) for n, r in enumerate(want, 1)]
    assert dict(placed.dtypes)["place"] == "bigint"
    assert L.placed(spark.createDataFrame([], "id long, at long"), [F.desc("at")]).collect() == []


def test_the_whole_library_is_sorted(spark, tmp_path):
    from quern.queries import queries

    spark.range(1200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 400).alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = queries()["library_sort"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 1201)) and [r.event_id for r in got[:4]] == [399, 799, 1199, 398]
