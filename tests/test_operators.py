import json
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import library as L
from quern.operators import search as S
from quern.operators import state as R
from quern.operators import timeseries as T
from quern.operators import topology as G
from quern.operators import turns as M
from quern.operators import usage as U


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def chat(spark):
    data = [("a", 0, "assistant", "hi"), ("a", 1, "user", "The Thing"), ("a", 2, "assistant", "the the"), ("a", 3, "user", "x"), ("b", 0, "user", "y")]
    return spark.createDataFrame(data, "s string, i int, role string, text string")


def test_turns_start_at_zero_and_rounds_at_one(chat):
    assert rows(M.turn_numbers(chat, "s", "i"), "s", "message", "turn_no") == [("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 1, 1)]
    assert rows(M.round_numbers(chat, "s", "i"), "s", "i", "round_no")[0] == ("a", 0, 1)


def test_spans_and_pages_never_split_a_turn(chat):
    assert rows(M.turn_spans(chat, "s", "i")) == [("a", 1, 3), ("a", 3, 4), ("b", 0, 1)]
    assert rows(M.page_ends(chat, "s", "i", 2)) == [("a", 3), ("b", 1)]


def test_chunks_merge_by_adjacent_kind(chat):
    data = chat.sparkSession.createDataFrame([("a", k, r, t) for k, (r, t) in enumerate([("u", "1"), ("u", "2"), ("v", "3"), ("u", "4")])], "s string, i int, role string, text string")
    assert rows(M.merge_chunks(data, "s", "i", "role", "text"), "chunk", "role", "parts", "text") == [(1, "u", 2, "1\n2"), (2, "v", 1, "3"), (3, "u", 1, "4")]


def test_each_call_is_paired_once(spark):
    calls = spark.createDataFrame([("k", 1), ("k", 3), ("m", 4)], "id string, ordinal int")
    results = spark.createDataFrame([("k", 2), ("o", 5)], "id string, ordinal int")
    assert rows(M.pair_calls(calls, results, ["id"]), "id", "state") == [("k", "paired"), ("k", "unpaired_call"), ("m", "unpaired_call"), ("o", "orphan_result")]


def test_budget_keeps_a_first_row_that_is_too_large(chat):
    assert rows(M.byte_budget(chat, "s", "i", "text", 1), "s", "i") == [("a", 0), ("b", 0)]


def test_times_become_strictly_increasing(spark):
    t = spark.createDataFrame([("a", 0, 5), ("a", 1, 5), ("a", 2, 3), ("a", 3, 20)], "s string, i int, t long")
    assert [r.t for r in M.strictly_increasing(t, "s", "i", "t").orderBy("i").collect()] == [5, 6, 7, 20]


def test_buffered_rows_go_to_the_next_assistant_message(spark):
    t = spark.createDataFrame([("a", 0, "user"), ("a", 1, None), ("a", 2, "assistant"), ("a", 3, None), ("a", 4, "user")], "s string, i int, role string")
    assert [r.owner for r in M.pending_owner(t, "s", "i").orderBy("i").collect()][1:4] == [2, 2, None]


def test_query_terms_and_literals():
    assert X.query_terms('foo OR "Bar baz" NOT qux') == ["foo", "bar baz", "qux"]
    assert X.required_literals(r"error: \d+ at line") == ["error: ", " at line"]
    assert X.required_literals("abc|def") == [] and X.required_literals("abcd?efg") == ["abc", "efg"]
    assert X.required_literals("(abc)+xyz") == ["xyz"] and X.java_regex("(?P<n>x)") is None


def test_snippets_and_clips(spark):
    df = spark.createDataFrame([("a" * 200 + "HIT" + "b" * 300,), ("none",)], "t string")
    a, b = [r[0] for r in df.select(X.snippet(F.col("t"), "hit")).collect()]
    assert a.startswith("…") and a.endswith("…") and "HIT" in a and b == "none"
    assert spark.range(1).select(X.clip(F.lit("a  b\n" + "c" * 90))).first()[0] == "a b " + "c" * 76 + "…"


def test_regex_falls_back_to_python(spark):
    df = spark.createDataFrame([("abc1",), ("abcd",)], "t string")
    assert rows(S.regex_scan(df, "t", r"(?P<w>abc)\d")) == [("abc1",)] == rows(S.regex_scan(df, "t", r"abc\d"))


def test_regex_scan_keeps_every_match(spark):
    texts = ["Abcd", "41bcd", "u0041bcd", "]", "abc", "\x01bcd", "Abcd", "a b c", "x|bcd", "[abc]", "q.abc.", "tabbcd", "\tbcd", "zzabc", "éabc", "ab{2}c", "abbc", "Abc\nbcd", "def", ")def", "xdef"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [r"\x41bcd", r"\u0041bcd", r"[\]abc]+", r"[^]abc]+", r"[]abc]+", r"[x[abc]+", r"(?x) abc # bcd", r"(?x:a b c)", r"(?i)ABC", r"(?s-i:a)bcd", r"(b)\1c", r"\tbcd", r"\babc\b", r"[x|]\|bcd", r"[(]abc|def", r"[)]def", r"\.abc\.", r"ab{2}c", r"abbc?", r"(abc)?def", r"(?!zz)..abc", r"\wabc", r"c$", r"c.bcd", r"[a&&b]"]
    for p in patterns:
        assert rows(S.regex_scan(df, "t", p)) == sorted((t,) for t in texts if re.search(p, t)), p
    assert X.required_literals(r"\[abc\]+def\w{3}") == ["[abc]", "def"] and X.required_literals("ERTION!+") == ["ERTION!"]
    assert X.required_literals("abc{x") == [] == X.required_literals(r"[\]abc]+")


def test_trigrams_find_supersets(spark):
    df = spark.createDataFrame([(1, "Hello World"), (2, "help")], "k int, t string")
    assert rows(S.posting_hits(S.trigram_postings(df, "k", "t"), "k", ["hello"])) == [(1,)]


def test_stored_postings_are_read_by_bucket_and_verified(spark, tmp_path):
    df = spark.createDataFrame([(1, "hello world"), (2, "hell ello"), (3, "HELLO"), (4, "")], "k int, t string")
    S.write_postings(S.trigram_postings(df, "k", "t"), f"file://{tmp_path}/i", 4)
    assert rows(S.stored_hits(spark, f"file://{tmp_path}/i", df, "k", "t", ["hello"], 4), "k") == [(1,), (3,)]


def test_rank_groups_and_ties(spark):
    df = spark.createDataFrame([(1, "m"), (2, "c"), (3, "mc"), (4, "")], "k int, t string")
    hits = S.combine_hits(df, df.where("t like 'm%'"), df.where("t like '%c'").withColumn("score", F.lit(1.0)), "k")
    assert [r.k for r in S.ranked(hits, "k", 10).collect()] == [3, 2, 1]


def test_price_rules(spark):
    prices = spark.createDataFrame([("a/m-1", 1.0, 0.0, 0.0, 0.0, 0), ("m", 2.0, 0.0, 0.0, 0.0, 1)], "name string, price_input double, price_output double, price_cache_read double, price_cache_write double, ordinal int")
    models = spark.createDataFrame([("M-1",), ("m-1-x",), ("m-2",), ("m1",), (None,)], "model string")
    assert rows(U.match_prices(models, prices), "model", "name") == [("M-1", "a/m-1"), ("m-1-x", "a/m-1"), ("m-2", "m")]


def test_streaks_and_trends(spark):
    days = spark.createDataFrame([("u", f"2024-01-{d:02d} 10:00:00", 1.0) for d in (1, 2, 3, 8, 9)], "u string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(T.streaks(days, "u", "ts", "2024-01-10")) == [("u", 3, 2)]
    assert rows(T.trends(days, "ts", "2024-01-09", days=2)) == [(0, 1, 1.0), (1, 1, 1.0)]
    assert rows(T.trends(days, "ts", "2024-01-09 00:00:00", days=2, parity=True)) == [(0, 1, 1.0), (1, 0, 0.0)]


def test_trees(spark):
    nodes = spark.createDataFrame([("r", None, 1), ("a", "r", 2), ("b", "a", 3), ("x", "y", 0), ("y", "x", 0), ("o", "gone", 0)], "id string, parent_id string, v int")
    assert rows(G.closure(nodes.where("v > 0"))) == [("a", "a", 0), ("a", "b", 1), ("b", "b", 0), ("r", "a", 1), ("r", "b", 2), ("r", "r", 0)]
    assert rows(G.roots(nodes)) == [("o",), ("r",), ("x",), ("y",)]
    gone = spark.createDataFrame([("a",)], "id string")
    assert rows(G.relinked(nodes.where("v > 0"), gone), "id", "parent_id") == [("b", "r"), ("r", None)]
    deep = spark.createDataFrame([(str(k), str(k - 1) if k else None) for k in range(300)], "id string, parent_id string")
    assert G.closure(deep).count() == 300 * 301 // 2


def test_tree_shape_ignores_order(spark):
    t = spark.createDataFrame([("1", None, "r"), ("2", "1", "a"), ("3", "1", "b"), ("4", None, "r"), ("5", "4", "b"), ("6", "4", "a"), ("7", None, "r")], "id string, parent_id string, label string")
    d = dict(rows(G.shape(t, "label")))
    assert d["1"] == d["4"] != d["7"]


def test_delta_turns_before_into_after(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, rev string")
    after = spark.createDataFrame([(2, "b"), (3, "d"), (4, "e")], "k int, rev string")
    d = R.delta(before, after, ["k"], "rev")
    assert rows(d) == [(1, "removal"), (3, "upsert"), (4, "upsert")]
    up = after.join(d.where("op = 'upsert'"), "k", "left_semi")
    assert rows(R.apply_delta(before, up, d.where("op = 'removal'"), ["k"])) == rows(after)


def test_state_table_is_versioned_and_conditional(spark, tmp_path):
    t = R.StateTable(spark, f"file://{tmp_path}/t", ["id"])
    df = lambda *x: spark.createDataFrame(list(x), "id int, status string")
    assert t.upsert(df((1, "planned"))) == 1 and t.upsert(df((2, "planned")), expected=1) == 2
    with pytest.raises(RuntimeError):
        t.upsert(df((3, "planned")), expected=1)
    t.move(F.col("id") == 1, "queued")
    assert rows(t.read()) == [(1, "queued"), (2, "planned")] and rows(t.read(1)) == [(1, "planned")]
    with pytest.raises(RuntimeError):
        t.move(F.col("id") == 1, "applied")
    t.insert_idempotent(df((2, "planned"), (5, "planned")), "status")
    with pytest.raises(ValueError):
        t.insert_idempotent(df((1, "planned")), "status")
    t.delete(df((5, "")))
    assert rows(t.read()) == [(1, "queued"), (2, "planned")]


def test_newest_row_wins_later_of_equals(spark):
    df = spark.createDataFrame([("k", 1, 0), ("k", 2, 1), ("k", 2, 2)], "k string, at int, n int")
    assert rows(L.newest(df, ["k"], "at", "n")) == [("k", 2, 2)]


def test_readers(spark, tmp_path):
    from quern.sources import transcripts as A

    sep = " "
    claude = [{"type": "summary", "timestamp": "2020-01-01T00:00:00Z", "cwd": "/x"}, {"type": "user", "cwd": "/w", "sessionId": "other", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": f"Do{sep}it"}}, {"type": "assistant", "message": {"role": "assistant", "model": "m1", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"p": 1}}], "usage": {"input_tokens": 5, "output_tokens": 2}}}, {"type": "assistant", "message": {"role": "assistant", "model": "<synthetic>", "content": "x", "usage": {"input_tokens": 99}}}]
    d = tmp_path / "c" / "p"
    (d / "s" / "subagents").mkdir(parents=True)
    text = "\n".join(json.dumps(x, ensure_ascii=False) for x in claude)
    (d / "s.jsonl").write_text(text)
    (d / "s" / "subagents" / "k.jsonl").write_text(text + "\n" + json.dumps({"type": "ai-title", "title": "T"}))
    (d / "torn.jsonl").write_text(text + '\n{"torn')
    lines = A.lines(spark, f"file://{tmp_path}/c")
    one, two = A.claude_rows(lines, f"file://{tmp_path}/c").orderBy("id").collect()
    assert (two["id"], two["count"], two["dir"], two["input"], two["output"], two["model"], two["created_ms"], two["parent_id"]) == ("s", 3, "/w", 5, 2, "m1", 1704067200000, None)
    assert (one["id"], one["title"], one["parent_id"], one["root_id"]) == ("k", "T", "s", "s")
    b = A.blocks(lines.where("file like '%/s.jsonl'")).orderBy("line_no", "block_idx").collect()
    assert [x["type"] for x in b] == ["text", "text", "tool_use", "text"] and b[0]["text"] == f"Do{sep}it"
    usage = lambda i, c, o, q: {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": q}}}}
    said = lambda t: {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": t}]}}
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "r.jsonl").write_text("\n".join(map(json.dumps, [{"type": "session_meta", "payload": {"id": "i", "cwd": "/d"}}, said("<env>"), said("Fix it"), usage(10, 4, 1, 1), usage(20, 5, 3, 2)])))
    r = A.codex_rows(A.lines(spark, f"file://{tmp_path}/x")).first()
    assert (r["id"], r["dir"], r["title"], r["input"], r["output"], r["cache_read"]) == ("i", "/d", "Fix it", 15, 5, 5)
    (tmp_path / "y").mkdir()
    say = lambda i, up, role, text, **more: {"type": "message", "id": i, "parentId": up, "message": {"role": role, "content": text, **more}}
    use = lambda n: {"input": n, "output": 1, "cacheRead": 0, "cacheWrite": 0}
    head = {"type": "session", "version": 3, "id": "q", "cwd": "/e", "timestamp": "2024-01-01T00:00:00Z"}
    pi = [head, say("1", None, "user", "Hello"), say("2", "1", "assistant", "a", model="m", usage=use(50)), say("3", "1", "assistant", "b", model="n", usage=use(7)), say("4", "3", "toolResult", "r", usage=use(9)), {"type": "message", "id": "9", "message": {"role": "user", "content": "no parent"}}]
    (tmp_path / "y" / "good.jsonl").write_text("\n".join(map(json.dumps, pi)) + '\n{"torn')
    (tmp_path / "y" / "bad.jsonl").write_text(json.dumps(pi[0]) + '\n{"torn\n' + json.dumps(pi[1]))
    (tmp_path / "y" / "also.jsonl").write_text("\n".join(map(json.dumps, [head | {"id": "z"}, say("1", None, "user", "Other"), say("3", "1", "user", "more")])))
    got = [(r["id"], r["count"], r["title"], r["model"], r["input"]) for r in A.pi_rows(A.lines(spark, f"file://{tmp_path}/y")).orderBy("id").collect()]
    assert got == [("q", 2, "Hello", "n", 7), ("z", 2, "Other", "", 0)]


def test_branches_of_sessions_that_share_ids(spark):
    r = spark.createDataFrame([("s1", "a", None, 0), ("s1", "b", "a", 1), ("s1", "x", "b", 2), ("s1", "b", "a", 3), ("s2", "x", None, 0), ("s2", "b", "x", 1), ("s3", "p", "q", 0), ("s3", "q", "p", 1)], "s string, id string, up string, at int")
    assert rows(G.active_branch(r, "s", "id", "up", "at")) == [("s1", "a", 1), ("s1", "b", 2), ("s2", "b", 2), ("s2", "x", 1), ("s3", "p", 1), ("s3", "q", 2)]
    deep = spark.createDataFrame([("d", k, k - 1 if k else None, k) for k in range(300)], "s string, id int, up int, at int")
    assert rows(G.active_branch(deep, "s", "id", "up", "at"), "id", "step") == [(k, k + 1) for k in range(300)]


def test_positions_do_not_need_gapless_order(spark):
    c = spark.createDataFrame([("a", 10, "user", "x"), ("a", 20, "assistant", "y"), ("a", 35, "user", "z")], "s string, i int, role string, text string")
    assert rows(M.turn_spans(c, "s", "i")) == [("a", 0, 2), ("a", 2, 3)] and rows(M.page_ends(c, "s", "i", 1)) == [("a", 2)]
    assert rows(M.page(c, "s", "i", "text", 0, 2, 99), "i", "next_message") == [(10, 2), (20, 2)]


def test_literals_may_meet_in_different_messages(spark):
    m = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "one")], "s string, t string")
    wanted = spark.createDataFrame([("a",), ("b",), ("new",)], "s string")
    assert rows(S.candidates(m, wanted, "s", "t", ["one", "two"])) == [("a",), ("new",)]


def test_older_revisions_change_nothing(spark, tmp_path):
    from quern.streaming import live as V

    table, seen = R.StateTable(spark, f"file://{tmp_path}/t", ["k"]), []
    batch = lambda *x: spark.createDataFrame(list(x), "k int, rev int")
    sink = V.delta_sink(table, ["k"], "rev", lambda g, d: seen.append((g, rows(d))))
    sink(batch((1, 5)), 0)
    sink(batch((1, 3)), 1)
    assert rows(table.read()) == [(1, 5)] and [g for g, _ in seen] == [1]

    def broken(g, d):
        raise OSError("consumer is gone")

    with pytest.raises(OSError):
        V.delta_sink(table, ["k"], "rev", broken)(batch((1, 6)), 2)
    sink(batch((1, 6)), 2)
    assert seen[-1] == (2, [(1, "upsert")])


def test_writer_round_trip(spark, tmp_path):
    from quern.sources import transcripts as A
    from quern.sources import writers as W

    m = spark.createDataFrame([("s", 1, "user", "a", 5, "/w"), ("s", 2, "assistant", "b", 5, "/w")], "session_id string, message_idx int, role string, text string, created_ms long, dir string")
    W.write_sessions(W.claude_lines(m), f"file://{tmp_path}/out")
    lines = A.lines(spark, f"file://{tmp_path}/out")
    assert [(b["role"], b["text"]) for b in A.blocks(lines).orderBy("line_no").collect()] == [("user", "a"), ("assistant", "b")]
    assert A.claude_rows(lines).first()["count"] == 2


def test_stream_merges_deltas(spark, tmp_path):
    from quern.streaming import live as V

    table, seen = R.StateTable(spark, f"file://{tmp_path}/live", ["k"]), []
    sink = V.delta_sink(table, ["k"], "rev", lambda g, d: seen.append((g, rows(d))))
    batch = lambda *x: spark.createDataFrame(list(x), "k int, rev int")
    batch((1, 1), (1, 2)).write.parquet(f"{tmp_path}/in/0")
    stream = V.stream_rows(spark, f"{tmp_path}/in/*", "k int, rev int")
    go = lambda: stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    go()
    batch((1, 2), (2, 1)).write.parquet(f"{tmp_path}/in/1")
    go()
    sink(batch((1, 2), (2, 1)), 9)
    assert seen == [(1, [(1, "upsert")]), (2, [(2, "upsert")])]


def test_tool_inputs_and_fidelity(spark):
    from quern.operators import tools as K

    cases = [
        ("fs.read", '{"file_path":"a"}', True), ("fs.read", '{"file_path":""}', False), ("fs.read", '{"file_path":"a","offset":true}', False), ("fs.read", '{"file_path":"a","offset":null}', True), ("fs.write", '{"file_path":"a"}', False),
        ("fs.write", '{"file_path":"a","content":""}', True), ("tool.invoke", '{"namespace":"n","name":"m","input":{"x":1}}', True), ("tool.invoke", '{"namespace":"n","name":"m","input":3}', False), ("fs.patch", '{"operations":[]}', True), ("nope", "{}", False), ("fs.read", "[1]", False), ("fs.read", "{torn", False), ("fs.read", None, False),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, op string, input string, want boolean")
    assert [r.got for r in df.select("k", K.valid_input("op", "input").alias("got")).orderBy("k").collect()] == [c[2] for c in cases]
    target = K.rules(spark, {"fs.read": ("transformed", ["file_path"]), "shell.exec": ("exact", ["command"]), "web.fetch": ("dropped", [])})
    calls = [
        ("shell.exec", '{"command":"ls","description":"d"}', "success", ["text"], 0, False, "exact"), ("shell.exec", '{"command":"ls","workdir":"/"}', "success", ["text"], 0, False, "lossy"), ("shell.exec", '{"command":"ls"}', "unknown", [], 0, False, "narrated"), ("shell.exec", '{"command":"ls"}', "success", ["json"], 0, False, "transformed"),
        ("shell.exec", '{"command":"ls"}', None, None, None, None, "exact"), ("shell.exec", '{"command":"ls"}', "success", ["image"], 0, False, "lossy"), ("shell.exec", '{"command":"ls"}', "success", [], 1, True, "lossy"), ("fs.read", '{"file_path":"a"}', "success", ["text"], 0, False, "transformed"), ("web.fetch", '{"url":"u"}', None, None, None, None, "dropped"), ("fs.glob", '{"pattern":"*"}', None, None, None, None, "narrated"), ("fs.read", "{}", None, None, None, None, "narrated"),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(calls)], "k int, op string, input string, status string, block_kinds array<string>, attachments int, truncated boolean, want string")
    got = K.decide(df, target, ["success", "error"], ["text"], ["json"])
    assert [r.fidelity for r in got.orderBy("k").collect()] == [c[-1] for c in calls]
    one = K.plan(got, spark.createDataFrame([("text",), ("image",), ("tool",)], "kind string"), spark.createDataFrame([("migration.truncated",), ("session.unpaired_tool_use",), ("other",)], "code string")).first()
    assert (one["native"], one["degrade"], one["drop"], one["exact"], one["lossy"], one["dropped"]) == (3, 9, 3, 3, 3, 2)


def test_database_and_bundles(spark, tmp_path):
    import sqlite3

    from quern.sources import stores as D

    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("create table session (id text, title text, directory text, time_updated int, time_created int, parent_id text)")
        db.execute("create table message (id text, session_id text, data text, time_created int)")
        db.executemany("insert into session values (?, ?, ?, ?, ?, ?)", [("s", "T", "/d", 5, 1, None), ("empty", "E", "/d", 5, 1, None)])
        say = lambda role, **x: json.dumps({"role": role, **x})
        db.executemany("insert into message values (?, 's', ?, ?)", [("1", say("user"), 1), ("2", say("assistant", modelID="m", tokens={"input": 3, "output": 2, "reasoning": 1, "cache": {"read": 7}}), 2), ("3", "torn{", 3)])
    read = lambda t, s: D.sqlite(spark, str(tmp_path / "a.db"), t, s)
    rows_ = D.database_rows(read("session", "id string, title string, directory string, time_updated long, time_created long, parent_id string"), read("message", "id string, session_id string, data string, time_created long")).collect()
    assert [(r["id"], r["count"], r["input"], r["output"], r["cache_read"], r["model"]) for r in rows_] == [("s", 3, 3, 3, 7, "m")]
    for k, fmt in (("a", 1), ("b", 2)):
        (tmp_path / "g" / k).mkdir(parents=True)
        (tmp_path / "g" / k / "summary.json").write_text(json.dumps({"info": {"id": k, "cwd": "/w"}, "generated_title": "", "session_summary": "S", "updated_at": "2024-01-01T00:00:00Z", "num_messages": 4, "chat_format_version": fmt}, indent=1))
    r = D.bundle_rows(spark, f"file://{tmp_path}/g").collect()
    assert [(x["id"], x["title"], x["count"], x["updated_ms"], x["root_id"]) for x in r] == [("a", "S", 4, 1704067200000, "a")]


def test_dialects_round_trip(spark):
    from quern.operators import dialects as D

    calls = {
        "claude": [("Bash", {"command": "ls", "timeout": 5}, "shell.exec", {"command": "ls", "timeout_ms": 5}), ("Edit", {"file_path": "a", "old_string": "x", "new_string": "y"}, "fs.edit", {"file_path": "a", "old": "x", "new": "y"}), ("Other", {"z": [1, {"k": None}]}, "tool.invoke", {"namespace": "claude", "name": "Other", "input": {"z": [1, {"k": None}]}})],
        "pi": [("bash", {"command": "ls", "timeout": 1.5}, "shell.exec", {"command": "ls", "timeout_ms": 1500}), ("read", {"path": "a"}, "fs.read", {"file_path": "a"})],
    }
    for tool, cases in calls.items():
        df = spark.createDataFrame([(k, c[0], json.dumps(c[1])) for k, c in enumerate(cases)], "k int, name string, input string")
        op, canonical = D.parse(tool, F.col("name"), F.col("input"))
        parsed = df.select("k", op.alias("op"), canonical.alias("canonical"))
        assert [(r.op, json.loads(r.canonical)) for r in parsed.orderBy("k").collect()] == [c[2:] for c in cases]
        name, native = D.render(tool, F.col("op"), F.col("canonical"))
        assert [(r[0], json.loads(r[1])) for r in parsed.orderBy("k").select(name, native).collect()] == [c[:2] for c in cases]
    one = spark.createDataFrame([("shell.exec", '{"command":"a","workdir":"/"}')], "op string, j string")
    assert one.select(D.unmapped("claude", F.col("op"), F.col("j"))).first()[0] == ["workdir"]


def test_tail_reads_only_whole_new_lines(spark, tmp_path):
    from quern.streaming.tail import TailReader, tail

    log = tmp_path / "a.jsonl"
    log.write_text("one\ntwo\n\nlonger than a step\nthr")
    reader = TailReader({"path": f"{tmp_path}/*.jsonl", "step": "3"})
    end = reader.latestOffset()
    assert end == {str(log): 28}
    parts = reader.partitions({}, end)
    assert len(parts) == 10 and [(r[1], r[2]) for p in parts for r in reader.read(p)] == [(0, "one"), (4, "two"), (9, "longer than a step")]
    assert reader.partitions(end, reader.latestOffset()) == []
    stream = tail(spark, f"{tmp_path}/*.jsonl").select("raw").writeStream.format("memory").queryName("tailed").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        stream.processAllAvailable()
        with log.open("a") as f:
            f.write("ee\n")
        for _ in range(20):
            stream.processAllAvailable()
            if spark.table("tailed").count() == 4:
                break
        assert sorted(r.raw for r in spark.table("tailed").collect()) == ["longer than a step", "one", "three", "two"]
    finally:
        stream.stop()
