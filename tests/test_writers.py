"""Canonical blocks written in each format and read again."""

import json

import pytest
from pyspark.sql import functions as F

from quern.sources import canonical as N
from quern.sources import writers as W

BLOCKS = "session string, message_idx long, block_idx long, role string, kind string, text string, name string, op string, call_id string, input string, status string, output string"
CALL = ("tool", None, "x", "shell.exec", "c1", json.dumps({"command": 'ls "a" é'}), "success", "out\n2")
FAILED = ("tool", None, "x", "fs.read", "c2", json.dumps({"file_path": "/a b"}), "error", "none")
ODD = ("tool", None, "odd", "no.such", "c3", "{}", "success", "z")


@pytest.fixture(scope="module")
def blocks(spark):
    text = lambda t: ("text", t, None, None, None, None, None, None)
    rows = [("s", 1, 0, "user", *text('q "1"\n')), ("s", 2, 0, "assistant", *text("a")), ("s", 2, 1, "assistant", *text("b")), ("s", 2, 2, "assistant", *CALL)]
    rows += [("s", 2, 3, "assistant", *FAILED), ("s", 2, 4, "assistant", *ODD), ("s", 3, 0, "user", *text("bye")), ("t", 1, 0, "user", *text("other"))]
    return spark.createDataFrame(rows, BLOCKS)


def shown(tables, session="s"):
    got = tables.blocks.where(F.col("session") == session).orderBy("message_idx", "block_idx").collect()
    return [(r.message_idx, r.role, r.text if r.kind == "text" else (r.op, json.loads(r.input), r.status, r.output)) for r in got]


def read(lines):
    """Lines as they are after a write: apart from the plan that made them."""
    lines = lines.sparkSession.createDataFrame(lines.collect(), lines.schema)
    return lines.select(F.col("session").alias("file"), (F.col("line_no") - 1).cast("int").alias("line_no"), "raw")


TOLD = "[History: tool odd was previously invoked]\nInput: {}\nResult:\nz"
SHELL = ("shell.exec", {"command": 'ls "a" é'}, "success", "out\n2")
READ = ("fs.read", {"file_path": "/a b"}, "error", "none")


def test_claude(blocks):
    lines = W.claude_records(blocks, 0, "/w").persist()
    t = N.claude(read(lines))
    assert shown(t) == [(1, "user", 'q "1"\n'), (2, "assistant", "a\n\nb"), (3, "assistant", SHELL), (4, "assistant", READ), (5, "assistant", TOLD), (6, "user", "bye")]
    assert shown(t, "t") == [(1, "user", "other")] and t.losses.count() == 0
    records = [json.loads(r.raw) for r in lines.where("session = 's'").orderBy("line_no").collect()]
    assert [r["parentUuid"] for r in records] == [None, *(r["uuid"] for r in records[:-1])] and records[0]["timestamp"] == "1970-01-01T00:00:02.000Z"
    assert W.claude_records(blocks.limit(0), 0, "/w").count() == 0
    assert [tuple(r) for r in W.degraded(blocks, "claude").collect()] == [("s", "migration.tool_degraded", "odd")]


def test_codex(spark, blocks):
    t = N.codex(read(W.codex_records(blocks, 0, "/w")))
    shell = ("shell.exec", {"command": "cat '/a b'"}, "error", "none")
    assert shown(t) == [(1, "user", 'q "1"\n'), (2, "assistant", "a\n\nb"), (3, "assistant", SHELL), (3, "assistant", shell), (3, "assistant", TOLD), (4, "user", "bye")]
    call = lambda k, op, **x: ("s", 1, k, "assistant", "tool", None, "x", op, f"c{k}", json.dumps(x), "success", "")
    edits = [call(0, "fs.edit", file_path="/a", old="x\ny", new="z"), call(1, "fs.write", file_path="/b", content="1\n2\n"), call(2, "fs.search", query="a b", glob="*.py"), call(3, "fs.glob", pattern="*.md", path="/d")]
    edits.append(call(4, "fs.edit", file_path="", old="x", new="y"))
    got = [(r.kind, r.op, r.input and json.loads(r.input)) for r in N.codex(read(W.codex_records(spark.createDataFrame(edits, BLOCKS), 0, "/w"))).blocks.orderBy("message_idx", "block_idx").collect()]
    assert got[:2] == [
        ("tool", "fs.patch", {"operations": [{"operation": "update", "path": "/a", "hunk_count": 1}], "raw_patch": "*** Begin Patch\n*** Update File: /a\n@@\n-x\n-y\n+z\n*** End Patch"}),
        ("tool", "fs.patch", {"operations": [{"operation": "add", "path": "/b", "hunk_count": 0}], "raw_patch": "*** Begin Patch\n*** Add File: /b\n+1\n+2\n*** End Patch"}),
    ]
    assert [x[2]["command"] for x in got[2:4]] == ["rg --line-number --color never -g '*.py' -- 'a b' .", "rg --files -g '*.md' -- /d"] and got[4][0] == "text"


def test_pi(blocks):
    t = N.pi(read(W.pi_records(blocks, 0, "/w")))
    assert shown(t) == [(1, "user", 'q "1"\n'), (2, "assistant", "a"), (2, "assistant", "b"), (2, "assistant", SHELL), (2, "assistant", READ), (2, "assistant", TOLD), (3, "user", "bye")]
    assert t.losses.count() == 0


def test_database(blocks):
    messages, parts = W.database_records(blocks, 0)
    messages, parts = (df.sparkSession.createDataFrame(df.collect(), df.schema) for df in (messages, parts))
    t = N.database(messages, parts)
    assert shown(t) == [(1, "user", 'q "1"\n'), (2, "assistant", "a"), (2, "assistant", "b"), (2, "assistant", SHELL), (2, "assistant", READ), (2, "assistant", TOLD), (3, "user", "bye")]
    data = {r.id: json.loads(r.data) for r in messages.where("session_id = 's'").collect()}
    ids = sorted(data)
    assert [data[i].get("parentID") for i in ids] == [None, ids[0], None]


def test_bundle(blocks):
    lines = W.bundle_records(blocks).persist()
    t = N.chat(read(lines.where("file = 'chat_history.jsonl'")))
    assert shown(t) == [(1, "user", 'q "1"\n'), (2, "assistant", "ab" + TOLD), (2, "assistant", SHELL), (2, "assistant", (*READ[:2], "success", "none")), (3, "user", "bye")]
    updates = [json.loads(r.raw)["params"]["update"] for r in lines.where("file = 'updates.jsonl' and session = 's'").orderBy("line_no").collect()]
    assert [u["sessionUpdate"] for u in updates] == ["user_message_chunk", "agent_message_chunk", "agent_message_chunk", "tool_call", "tool_call_update", "tool_call", "tool_call_update", "agent_message_chunk", "user_message_chunk"]
    assert [u["_meta"]["promptIndex"] for u in updates if "_meta" in u] == [0, 1] and updates[3]["rawInput"] == {"command": 'ls "a" é'}
    assert [u["status"] for u in updates if "status" in u] == ["pending", "completed", "pending", "failed"]


def test_spawns_meet_children_in_order(spark):
    from quern.operators.agents import spawn_matches

    calls = [("p", "c1", "uses <a> and <b>", 1), ("p", "c2", "uses <a>", 2), ("p", "c3", "uses <b> or <n>", 3), ("p", "c4", "uses <b>", 4), ("q", "c1", "<a>", 1), ("q", "c5", "", 2)]
    children = [("p", "A", "<a>", 1), ("p", "A", "<n>", 1), ("p", "B", "<b>", 2), ("p", "C", "", 3), ("q", "A", "<z>", 1)]
    c = spark.createDataFrame(calls, "parent string, call_id string, haystack string, ordinal int")
    d = spark.createDataFrame(children, "parent string, child string, identity string, ordinal int")

    want, used = [], set()
    for parent, call, text, _ in calls:  # one call after the other
        mine = [k for p, k, identity, _ in children if p == parent and identity and identity in text and (p, k) not in used]
        if mine:
            used.add((parent, mine[0]))
            want.append((parent, call, mine[0]))
    assert sorted(map(tuple, spawn_matches(c, d).collect())) == want == [("p", "c1", "A"), ("p", "c3", "B")]
    assert spawn_matches(c.limit(0), d).count() == 0


def test_edits(spark):
    from quern.operators.edits import deleted_turns, rewritten

    rows = [("s", "a", None, 1, 1, "x"), ("s", "b", "a", 2, 2, "x"), ("s", "c", "b", 2, 3, "x"), ("s", "d", "c", 3, 4, "x"), ("s", "e", "gone", 3, 5, "x"), ("s", "f", "a", None, 6, "x"), ("t", "b", None, 2, 1, "x"), ("t", "d", "b", 3, 2, "x")]
    records = spark.createDataFrame(rows, "session string, uuid string, parent string, turn int, at int, more string")
    turns = spark.createDataFrame([("s", 2), ("s", 2)], "session string, turn int")
    got = sorted(tuple(r) for r in deleted_turns(records, turns).select("session", "uuid", "parent", "more").fillna("-").collect())
    assert got == [("s", "a", "-", "x"), ("s", "d", "a", "x"), ("s", "e", "gone", "x"), ("s", "f", "a", "x"), ("t", "b", "-", "x"), ("t", "d", "b", "x")]
    loop = spark.createDataFrame([("s", "a", "b", 1, 1), ("s", "b", "a", 1, 2)], "session string, uuid string, parent string, turn int, at int")
    assert deleted_turns(loop, turns).count() == 2
    with pytest.raises(ValueError):
        deleted_turns(loop, spark.createDataFrame([("s", 1)], "session string, turn int"))

    parts = [("s", "a", 0, "text", "1"), ("s", "a", 1, "image", None), ("s", "a", 2, "text", "2"), ("s", "b", 0, "image", None), ("t", "a", 0, "text", "3")]
    parts = spark.createDataFrame(parts, "session string, uuid string, part int, type string, text string")
    out, refused = rewritten(parts, spark.createDataFrame([("s", "a", "new"), ("s", "b", "new"), ("s", "z", "new")], "session string, uuid string, text string"))
    assert sorted(tuple(r) for r in out.fillna("-").collect()) == [("s", "a", 0, "text", "new"), ("s", "a", 1, "image", "-"), ("s", "b", 0, "image", "-"), ("t", "a", 0, "text", "3")]
    assert sorted(map(tuple, refused.collect())) == [("s", "b", "no_text"), ("s", "z", "stale")]
