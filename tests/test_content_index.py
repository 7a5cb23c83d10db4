"""The content index in generations, and searches that use it, against scans."""

import pytest

from quern.operators import content_index as I
from quern.operators import sessions as C

SESSIONS = "session string, tool string, title string, dir string, model string, updated long, size long, count long, revision string, readable boolean"
SAID = "session string, message long, role string, text string, tool_text string"


def sessions_of(spark, *rows):
    return spark.createDataFrame([(s, "pi", f"title {s}", "/w", "m", at, 100, 1, rev, ok) for s, at, rev, ok in rows], SESSIONS)


def done(df):
    return {r.session: r.action for r in df.collect()}


@pytest.fixture
def said(spark):
    rows = [("a", 1, "user", "alpha needle7 omega", None), ("a", 2, "assistant", None, "tool says haystack"), ("b", 1, "user", "nothing", None), ("c", 1, "user", "x" * 700 + " needle9 " + "y" * 700, None), ("d", 1, "user", "needle8 here", "haystack too")]
    return spark.createDataFrame(rows, SAID)


def test_syncs_index_change_fail_and_remove(spark, tmp_path, said):
    path = f"file://{tmp_path}/i"
    assert I.live(spark, path).collect() == [] and I.lookup(spark, path, "needle").collect() == []
    first = sessions_of(spark, ("a", 5, "1", True), ("b", 4, "1", False), ("c", 3, "1", True))
    assert done(I.sync(spark, path, first, said, rows=2)) == {"a": "index_now", "b": "fail", "c": "index_later"}
    # a failed session waits for its next revision; c is next
    assert done(I.sync(spark, path, first, said, rows=2)) == {"a": "keep", "b": "keep", "c": "index_now"}
    assert {tuple(r) for r in I.lookup(spark, path, "needle").collect()} == {("a", 1), ("c", 1)}
    changed = said.where("session <> 'a'").unionByName(spark.createDataFrame([("a", 1, "user", "no more", None)], SAID))
    second = sessions_of(spark, ("a", 6, "2", True), ("b", 4, "2", True), ("d", 1, "1", True))
    assert done(I.sync(spark, path, second, changed)) == {"a": "index_now", "b": "index_now", "c": "remove", "d": "index_now"}
    assert {tuple(r) for r in I.lookup(spark, path, "needle").collect()} == {("d", 1)}
    assert {(r.session, r.state) for r in I.live(spark, path).collect()} == {("a", "indexed"), ("b", "indexed"), ("d", "indexed")}
    assert done(I.sync(spark, path, second, changed)) == {"a": "keep", "b": "keep", "d": "keep"}
    assert I.lookup(spark, path, "ab") is None
    # postings without the row that ends a sync do not count
    spark.createDataFrame([("nee", "zz", 1, 0)], "gram string, session string, message long, bucket int").write.partitionBy("bucket").parquet(f"{path}/postings/generation=99")
    assert {tuple(r) for r in I.lookup(spark, path, "nee").collect()} == {("d", 1)}


def found(df):
    return [(r.session, r.content_match_count, [(x.message, x.turn, x.snippet) for x in r.rows]) for r in df.orderBy("place").collect()]


def test_searches_with_an_index_equal_scans(spark, tmp_path, said):
    path = f"file://{tmp_path}/i"
    s = sessions_of(spark, ("a", 5, "1", True), ("b", 4, "1", True), ("c", 3, "1", True), ("d", 2, "1", True))
    I.sync(spark, path, s, said, rows=3)  # d is not indexed yet
    for more in ({"query": "needle"}, {"query": "haystack"}, {"query": "haystack", "tool_outputs": False}, {"query": "needle haystack"}, {"query": "omega", "more": ["here"]}, {"regex": r"needle\d"}, {"regex": r"hay\w+"}):
        scan, quick = C.search_sessions(s, said, scope="content", **more), C.search_sessions(s, said, scope="content", index=path, **more)
        assert found(scan) == found(quick), more
        assert {r.unindexed_sessions for r in quick.collect()} <= {1}
    assert found(C.search_sessions(s, said, "needle haystack", scope="content"))[0][:2] == ("d", 1)
    assert {r[0] for r in found(C.search_sessions(s, said, "haystack", scope="content"))} == {"a", "d"}
    assert found(C.search_sessions(s, said, "haystack", scope="content", tool_outputs=False)) == []


def test_snippets_hold_the_match_of_any_pattern(spark, said):
    s = sessions_of(spark, ("a", 5, "1", True), ("c", 3, "1", True))
    got = found(C.search_sessions(s, said, regex=r"needle\d", scope="content"))
    assert [x[2][0][2].count("needle") for x in got] == [1, 1] and got[1][2][0][2].startswith("…")


def test_a_byte_budget_skips_and_says_so(spark, tmp_path, said):
    path = f"file://{tmp_path}/i"
    s = sessions_of(spark, ("a", 5, "1", True), ("b", 4, "1", True), ("c", 3, "1", True), ("d", 2, "1", True))
    out = C.search_sessions(s, said, regex=r"needle\d", scope="content", scan_bytes=150).collect()
    assert [(r.session, r.scanned_sessions, r.skipped_sessions) for r in out] == [("a", 1, 3)]
    I.sync(spark, path, s, said)
    out = C.search_sessions(s, said, regex=r"needle\d", scope="content", scan_bytes=250, index=path).orderBy("place").collect()
    assert [(r.session, r.scanned_sessions, r.skipped_sessions) for r in out] == [("a", 2, 1), ("c", 2, 1)]
    assert out[0].rows[0].turn == 1


def test_sessions_beyond_a_list_are_joined(spark, said):
    few = spark.createDataFrame([("a",), ("b",)], "session string")
    plan = C.of_sessions(said, few)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and C.of_sessions(said, few).count() == C.of_sessions(said, few, 1).count() == 3
    assert C.of_sessions(said, few.limit(0)).count() == 0
