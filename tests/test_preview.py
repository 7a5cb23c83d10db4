"""Differences of a migration as rows."""

import json

from quern.operators import preview as P
from quern.operators import tools as T

BLOCKS = "session string, message_idx long, block_idx int, role string, kind string, text string, name string, op string, input string, output string, status string, block_kinds array<string>, attachments int, truncated boolean"


def test_paths_follow_the_order_of_siblings(spark):
    nodes = spark.createDataFrame([("r", None, 5, "t"), ("b", "r", 2, "t"), ("a", "r", 1, "t"), ("x", "b", 9, "t"), ("s", None, 1, "t")], "session string, parent string, ordinal int, title string")
    assert {r.session: r.path for r in P.node_paths(nodes).collect()} == {"r": "0", "a": "0.0", "b": "0.1", "x": "0.1.0", "s": "0"}


def test_rows_of_one_tree(spark):
    nodes = spark.createDataFrame([("r", None, 0, "Root"), ("k", "r", 0, None)], "session string, parent string, ordinal int, title string")
    tool = lambda s, m, b, op, value, output=None, status=None, **more: (s, m, b, "assistant", "tool", None, "Native", op, json.dumps(value), output, status, more.get("kinds", []), 0, False)
    plain = lambda s, m, b, role, kind, text: (s, m, b, role, kind, text, None, None, None, None, None, [], 0, False)
    rows = [
        plain("r", 1, 0, "assistant", "thinking", "before any user"),
        plain("r", 2, 0, "user", "text", "go"),
        tool("r", 3, 0, "shell.exec", {"command": "ls", "timeout_ms": 3}, "out " * 900, "success"),
        tool("r", 3, 1, "shell.exec", {"command": "ls"}, "x", "success"),
        tool("r", 3, 2, "web.fetch", {"url": "u"}),
        tool("r", 3, 3, "fs.read", {"file_path": "f"}),
        plain("k", 1, 0, "user", "image", "a.png"),
    ]
    b = spark.createDataFrame(rows, BLOCKS)
    rules = T.rules(spark, {"shell.exec": ("exact", ["command"]), "fs.read": ("dropped", [])})
    decided = T.decide(b.where("kind = 'tool'"), rules, ["success"], ["text"], [])
    losses = spark.createDataFrame([("k", "migration.fork_parent_fallback", "p"), ("k", "unknown.code", "q")], "session string, code string, detail string")
    got = {r.id: r for r in P.differences(nodes, b.drop("output", "input", "op"), decided, losses, "codex").collect()}
    assert {i: (r.kind, r.fidelity, r.reason_code, r.round_index, r.anchor_id, r.scope) for i, r in got.items()} == {
        "n:0/m:0/b:0/difference": ("dropped", "dropped", "unsupported_thinking", 1, "n:0/r:1", "block"),
        "n:0/m:2/b:0/difference": ("degraded", "lossy", "unsupported_tool_fields", 1, "n:0/r:1", "block"),
        "n:0/m:2/b:2/difference": ("degraded", "narrated", "tool_to_history", 1, "n:0/r:1", "block"),
        "n:0/m:2/b:3/difference": ("dropped", "dropped", "tool_unsupported", 1, "n:0/r:1", "block"),
        "n:0.0/m:0/b:0/difference": ("dropped", "dropped", "unsupported_image", 1, None, "block"),
        "n:0.0/loss:0": ("degraded", "narrated", "migration.fork_parent_fallback", None, None, "node"),
    }
    lossy, told = got["n:0/m:2/b:0/difference"], got["n:0/m:2/b:2/difference"]
    assert lossy.ignored_fields == ["timeout_ms"] and lossy.consumed_fields == ["command"] and lossy.node_title == "Root"
    assert lossy.source.truncated and len(lossy.source.summary) == 181 and len(lossy.source.detail) == 2502
    assert lossy.target.kind == "tool" and lossy.target.label != "history"
    assert told.target.kind == "text" and told.target.summary.startswith("[History: tool Native was previously invoked]")
    assert got["n:0/m:2/b:3/difference"].target is None and got["n:0.0/loss:0"].source.kind == "event"
