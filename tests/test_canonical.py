"""Native records to canonical tables, on small made-up transcripts."""

import json

from pyspark.sql import functions as F

from quern.sources import canonical as N


def lines(spark, **files):
    rows = [(name, k, x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) for name, items in files.items() for k, x in enumerate(items)]
    return spark.createDataFrame(rows, "file string, line_no int, raw string")


def shown(tables, session="s"):
    got = tables.blocks.where(F.col("session") == session).orderBy("message_idx", "block_idx").collect()
    return [(r.message_idx, r.role, r.kind, r.text if r.kind != "tool" else (r.op, r.status, r.output)) for r in got]


def lost(tables):
    return sorted((r.code, r.detail) for r in tables.losses.collect())


def test_claude_messages_calls_and_losses(spark):
    say = lambda kind, content, **more: {"type": kind, "uuid": more.get("uuid"), "message": {"role": kind, "content": content}, **more}
    use = lambda i, name="Bash", **x: {"type": "tool_use", "id": i, "name": name, "input": x}
    result = lambda i, text, **more: {"type": "tool_result", "tool_use_id": i, "content": text, **more}
    rows = lines(
        spark,
        s=[
            say("user", "[1] start"),
            say("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "thinking", "thinking": " "}, use("a", command="ls"), use("b", command="x")]),
            say("user", [result("a", [{"type": "text", "text": "out"}]), result("zz", "?")]),
            say("user", [result("b", "bad", is_error=True), {"type": "text", "text": "go on"}]),
            say("user", "aside", isSidechain=True),
            say("user", "meta", isMeta=True),
            say("assistant", [use("c", command="never"), {"type": "odd"}]),
            "{torn",
        ],
        t=[say("user", "other session")],
    )
    t = N.claude(rows)
    assert shown(t) == [
        (1, "user", "text", "[1] start"),
        (2, "assistant", "text", "hm"),
        (2, "assistant", "tool", ("shell.exec", "success", "out")),
        (2, "assistant", "tool", ("shell.exec", "error", "bad")),
        (3, "user", "text", "go on"),
        (4, "assistant", "tool", ("shell.exec", None, None)),
    ]
    assert shown(t, "t") == [(1, "user", "text", "other session")] and t.messages.count() == 5
    assert lost(t) == [
        ("migration.reasoning_dropped", "signature"),
        ("migration.reasoning_metadata_dropped", "signature"),
        ("migration.unknown_block_dropped", "odd"),
        ("session.malformed_record", "8"),
        ("session.orphan_tool_result", "zz"),
        ("session.unpaired_tool_use", "Bash"),
    ]
    assert N.claude(rows.limit(0)).messages.count() == 0


def test_claude_compactions(spark):
    rows = lines(
        spark,
        s=[
            {"type": "user", "uuid": "u", "message": {"role": "user", "content": "a"}},
            {"type": "system", "uuid": "y", "parentUuid": "u"},
            {"type": "system", "subtype": "compact_boundary", "uuid": "b", "logicalParentUuid": "y", "compactMetadata": {"trigger": "auto"}},
            {"type": "user", "uuid": "m", "parentUuid": "b", "isCompactSummary": True, "message": {"role": "user", "content": "summary"}},
            {"type": "system", "subtype": "compact_boundary", "uuid": "c", "logicalParentUuid": "u"},
        ],
    )
    got = [(r.id, r.after_message_id, r.trigger, r.state, r.summary_message_id) for r in N.claude(rows).compactions.orderBy("ordinal").collect()]
    assert got == [("b", "u", "automatic", "completed", "m"), ("c", "u", "unknown", "incomplete", None)]


def test_codex_buffers_close_at_the_next_speaker(spark):
    item = lambda **p: {"type": "response_item", "timestamp": "t", "payload": p}
    said = lambda role, text: item(type="message", role=role, content=[{"type": "input_text" if role == "user" else "output_text", "text": text}])
    call = lambda i: item(type="function_call", name="shell", call_id=i, arguments=json.dumps({"command": "ls"}))
    rows = lines(
        spark,
        s=[
            {"type": "session_meta", "payload": {"id": "x"}},
            said("user", "<environment_context>no"),
            said("user", "hello"),
            call("a"),
            item(type="reasoning", summary=[{"text": "why"}]),
            item(type="function_call_output", call_id="a", output=json.dumps({"output": "ok", "metadata": {"exit_code": 0}})),
            said("assistant", "done"),
            call("b"),
            said("user", "stop"),
            {"type": "compacted", "payload": {"message": "sum", "replacement_history": [{"type": "x"}]}},
            item(type="function_call_output", call_id="nope", output="o"),
            call("c"),
            item(type="odd"),
        ],
    )
    t = N.codex(rows)
    assert shown(t) == [
        (1, "user", "text", "hello"),
        (2, "assistant", "text", "why"),
        (2, "assistant", "tool", ("shell.exec", "success", "ok")),
        (2, "assistant", "text", "done"),
        (3, "assistant", "tool", ("shell.exec", None, None)),
        (4, "user", "text", "stop"),
        (5, "assistant", "tool", ("shell.exec", None, None)),
    ]
    assert lost(t) == [("migration.reasoning_metadata_dropped", "encrypted_content"), ("migration.unknown_block_dropped", "odd"), ("session.orphan_tool_result", "nope")]
    assert [(r.after_message_id, r.summary_status, r.replaces) for r in t.compactions.collect()] == [("record:8", "available", True)]


def test_pi_reads_the_active_branch(spark):
    say = lambda i, up, role, content, **m: {"type": "message", "id": i, "parentId": up, "message": {"role": role, "content": content, **m}}
    rows = lines(
        spark,
        s=[
            {"type": "session", "version": 3, "id": "q"},
            say("1", None, "user", "Hi"),
            say("x", "1", "assistant", "left"),
            say("2", "1", "assistant", [{"type": "thinking", "thinking": "t"}, {"type": "toolCall", "id": "k", "name": "read", "arguments": {"path": "f"}}]),
            say("3", "2", "toolResult", [{"type": "text", "text": "body"}], toolCallId="k"),
            {"type": "compaction", "id": "4", "parentId": "3", "summary": "S"},
            {"type": "message", "id": "5", "parentId": "4", "message": {"role": "bashExecution", "command": "ls", "output": "o", "exitCode": 2}},
            {"type": "branch_summary", "id": "6", "parentId": "5", "summary": "B"},
            "{torn",
        ],
    )
    t = N.pi(rows)
    assert shown(t) == [(1, "user", "text", "Hi"), (2, "assistant", "thinking", "t"), (2, "assistant", "tool", ("fs.read", "success", "body")), (3, "user", "tool", ("shell.exec", "error", "o")), (4, "user", "text", "B")]
    assert lost(t) == [("migration.unknown_block_dropped", "inactive_branch x")]
    assert [(r.id, r.after_message_id, r.summary_text) for r in t.compactions.collect()] == [("4", "2", "S")]


def test_database_parts_and_summaries(spark):
    message = [("m1", {"role": "user"}), ("m2", {"role": "assistant"}), ("m3", {"role": "user"}), ("m4", {"role": "assistant", "summary": True})]
    part = [("p1", "m1", {"type": "text", "text": "q"}), ("p2", "m2", {"type": "step-start"}), ("p3", "m2", {"type": "reasoning", "text": "r"}), ("p4", "m2", {"type": "tool", "tool": "bash", "callID": "k", "state": {"status": "completed", "input": {"command": "ls"}, "output": "o"}}), ("p5", "m3", {"type": "compaction", "auto": True}), ("p6", "m4", {"type": "text", "text": "sum"}), ("p7", "m4", {"type": "odd"})]
    m = spark.createDataFrame([(i, "s", json.dumps(d), k) for k, (i, d) in enumerate(message)], "id string, session_id string, data string, time_created long")
    p = spark.createDataFrame([(i, mid, "s", json.dumps(d), k) for k, (i, mid, d) in enumerate(part)], "id string, message_id string, session_id string, data string, time_created long")
    t = N.database(m, p)
    assert shown(t) == [(1, "user", "text", "q"), (2, "assistant", "text", "r"), (2, "assistant", "tool", ("shell.exec", "success", "o")), (3, "assistant", "text", "sum")]
    assert lost(t) == [("migration.reasoning_metadata_dropped", "metadata"), ("migration.unknown_block_dropped", "odd")]
    assert [(r.id, r.after_message_id, r.trigger, r.state, r.summary_message_id) for r in t.compactions.collect()] == [("m3", "m2", "automatic", "completed", "m4")]


def test_chat_history_of_a_bundle(spark):
    rows = lines(spark, s=[{"type": "user", "content": [{"type": "text", "text": "q"}]}, {"type": "assistant", "content": "a", "tool_calls": [{"id": "k", "name": "run_terminal_command", "arguments": {"command": "ls"}}]}, {"type": "reasoning", "content": "why"}, {"type": "tool_result", "tool_call_id": "k", "content": "out"}])
    assert shown(N.chat(rows)) == [(1, "user", "text", "q"), (2, "assistant", "text", "a"), (2, "assistant", "tool", ("shell.exec", "success", "out")), (2, "assistant", "thinking", "why")]


def test_rewinds_cut_what_they_take_back(spark):
    def user(text, n=None):
        return {"method": "session/update", "params": {"update": {"sessionUpdate": "user_message_chunk", "text": text, "_meta": {} if n is None else {"promptIndex": n}}}}

    agent = lambda text: {"method": "session/update", "params": {"update": {"sessionUpdate": "agent_message_chunk", "text": text}}}
    back = lambda n: {"method": "_x.ai/session/update", "params": {"update": {"sessionUpdate": "rewind_marker", "target_prompt_index": n}}}
    rows = lines(
        spark,
        s=[user("a", 0), agent("1"), user("b", 1), user("b2", 1), agent("2"), back(1), user("c", 1), back(7), back(2)],
        t=[user("x"), user("y"), agent("3"), user("z"), back(1), user("w")],
        u=[agent("only")],
    )
    got = {}
    for r in N.without_rewound(rows).orderBy("at").collect():
        got.setdefault(r.session, []).append(json.loads(r.raw)["params"]["update"].get("text", "marker"))
    assert got == {"s": ["a", "1", "c", "marker"], "t": ["x", "y", "3", "w"], "u": ["only"]}
