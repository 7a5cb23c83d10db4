"""Streamed updates to messages; rewinds; anchors of compactions."""

import json

from pyspark.sql import functions as F

from quern.sources import canonical as N
from quern.sources import updates as U

from .test_canonical import lines, lost, shown


def event(prompt=None, index=None, call=None, kind=None, status=None, raw_input=None, raw_output=None, tool=None, content=None, update_type="ToolCallUpdate", **more):
    update = {"kind": kind, "rawInput": raw_input, "rawOutput": raw_output, "content": content, "_meta": {"x.ai/tool": {"name": tool}} if tool else None, **more}
    params = {"toolCallId": call, "kind": kind, "status": status}
    meta = {"updateType": update_type, "promptId": prompt, "promptIndex": index, "updateParams": {k: v for k, v in params.items() if v}}
    some = lambda d: {k: v for k, v in d.items() if v is not None}
    return {"method": "session/update", "params": {"update": some(update), "_meta": some(meta)}}


def say(role, text, **more):
    return event(content={"type": "text", "text": text}, update_type={"user": "UserMessage", "text": "AgentMessageChunk", "thinking": "AgentThoughtChunk"}[role], **more)


def test_a_call_is_folded_over_its_updates(spark):
    t = U.updates(lines(spark, s=[
        event(call="x", raw_output="first"),
        event(update_type="ToolCall", prompt="p1", index=0, call="x", raw_input={"command": "pwd"}, tool="Shell", status="Pending"),
        event(prompt="p1", call="x", raw_output="complete", status="Completed"),
        event(call="x", raw_output="complete\nlate", status="InProgress"),
    ]))
    assert shown(t) == [(1, "assistant", "tool", ("shell.exec", "success", "complete\nlate"))] and lost(t) == []
    row = t.blocks.collect()[0]
    assert (row.name, json.loads(row.input), row.call_id, row.source_id) == ("Shell", {"command": "pwd"}, "x", "p1:assistant")


def test_updates_without_a_prompt_follow_their_call(spark):
    t = U.updates(lines(spark, s=[
        event(update_type="ToolCall", prompt="p1", call="a", kind="Shell", raw_input={"command": "one"}),
        event(update_type="ToolCall", prompt="p2", call="b", kind="Shell", raw_input={"command": "two"}),
        event(call="b", raw_output="two output"),
        event(call="a", raw_output={"type": "Bash", "output": [111, 107], "exit_code": 2}, status="completed"),
        event(call="orphan", raw_output="nowhere"),
        event(update_type="ToolCall", prompt="p1", call="both"),
        event(update_type="ToolCall", prompt="p2", call="both"),
        event(prompt="p1"),
    ]))
    assert shown(t) == [(1, "assistant", "tool", ("shell.exec", "error", "ok")), (2, "assistant", "tool", ("shell.exec", "unknown", "two output"))]
    assert lost(t) == [("migration.unknown_block_dropped", "session_update 1"), ("migration.unknown_block_dropped", "session_update 3")]


def test_chunks_join_and_calls_stand_between(spark):
    t = U.updates(lines(spark, s=[
        say("user", "Hel", prompt="p", index=3), say("user", "lo", index=3),
        say("thinking", "h", prompt="p"), say("thinking", "m", prompt="p"), say("text", "a", prompt="p"), say("text", "b", prompt="p"),
        event(update_type="ToolCall", prompt="p", call="c", title="grep"),
        say("text", "c", prompt="p"), event(prompt="p", call="c", content=[{"text": "x"}, "y", [{"text": "z"}]], status="failed"), say("text", "d", prompt="p"),
        say("text", "", prompt="q"), say("thinking", "alone", prompt="q"),
        event(update_type="Compaction", prompt="q", id="k", summary="short", tokensBefore=90), event(update_type="Odd", prompt="q"),
    ]))
    assert [(*r[:3], r[3] if r[2] != "tool" else r[3][1:]) for r in shown(t)] == [
        (1, "user", "text", "Hello"),
        (2, "assistant", "thinking", "hm"),
        (2, "assistant", "text", "ab"),
        (2, "assistant", "tool", ("error", "xyz")),
        (2, "assistant", "text", "cd"),
        (3, "assistant", "thinking", "alone"),
    ]
    c = t.compactions.collect()
    assert [(r.id, r.after_message_id, r.summary_text, r.metrics) for r in c] == [("k", "q:assistant", "short", {"tokens_before": 90})]
    assert lost(t) == [("migration.unknown_block_dropped", "session_update 1")]


def test_nameless_updates_are_numbered_by_the_prompts_before_them(spark):
    t = U.updates(lines(spark, s=[
        say("user", "a"), say("text", "b"), say("user", "c", index=2), say("text", "d", prompt="p"), say("text", "e"), say("text", "f", index=9), say("user", "g"),
        "{torn", "[1]", "{torn at the end",
    ], t=[say("text", "other")]))
    got = {(r.session, r.source_id): r.n for r in t.messages.select("session", "source_id", F.col("message_idx").alias("n")).collect()}
    # prompts in order: prompt:0, prompt:1, prompt:2 (index 2), p, prompt:4, prompt:9, prompt:6
    assert got == {("s", "prompt:0:user"): 1, ("s", "prompt:1:assistant"): 2, ("s", "prompt:2:user"): 3, ("s", "p:assistant"): 4, ("s", "prompt:4:assistant"): 5, ("s", "prompt:9:assistant"): 6, ("s", "prompt:6:user"): 7, ("t", "prompt:0:assistant"): 1}
    assert lost(t) == [("session.malformed_record", "8"), ("session.malformed_record", "9")]
    assert U.updates(lines(spark, s=["{"]).limit(0)).messages.collect() == []


def test_sessions_without_updates_are_read_from_their_chat(spark):
    chat = lines(spark, s=[{"type": "user", "content": "from chat"}], t=[{"type": "user", "content": "kept"}])
    t = U.bundles(lines(spark, s=[say("user", "from updates")], t=["{torn"]), chat)
    assert shown(t) == [(1, "user", "text", "from updates")] and shown(t, "t") == [(1, "user", "text", "kept")]


def brute_visible(items):
    """The lines left after markers, by running through all visible lines again at each marker."""

    def starts(visible):
        out, saw, key, run = [], False, None, False
        for n, x in enumerate(visible):
            if x[0] != "u":
                run = False
            elif x[1] is not None:
                if key != x[1]:
                    out.append(n)
                saw, key, run = True, x[1], False
            elif not saw and not run:
                out.append(n)
                key, run = None, True
        return out

    visible = []
    for x in items:
        if x[0] != "m":
            visible.append(x)
            continue
        at = starts(visible)
        if x[1] is not None and 0 <= x[1] < len(at):
            visible = visible[: at[x[1]]]
        elif x[1] is None or x[1] != len(at):
            visible.append(x)
    return [x[2] for x in visible]


def test_rewinds_match_a_plain_walk(spark):
    import random

    rng, files, want = random.Random(5), {}, {}
    for s in range(40):
        items = [(kind := rng.choice("uuuoom"), rng.choice([None, 0, 1, 2, 3]) if s % 2 or kind == "m" else None, n) for n in range(rng.randrange(1, 40))]
        want[f"s{s}"] = brute_visible(items)
        made = []
        for kind, value, _ in items:
            if kind == "m":
                made.append({"method": "_x.ai/session/update", "params": {"update": {"sessionUpdate": "rewind_marker", "target_prompt_index": value}}})
            else:
                meta = {"promptIndex": value} if value is not None and kind == "u" else {}
                made.append({"method": "session/update", "params": {"update": {"sessionUpdate": "user_message_chunk" if kind == "u" else "agent_message_chunk", "_meta": meta}}})
        files[f"s{s}"] = made
    got = {}
    for r in N.without_rewound(lines(spark, **files)).orderBy("session", "at").collect():
        got.setdefault(r.session, []).append(r["at"])
    assert got == {s: v for s, v in want.items() if v}


def test_anchors_are_walked_however_far(spark):
    system = [{"type": "system", "uuid": f"y{k}", "parentUuid": f"y{k - 1}" if k else "u"} for k in range(20)]
    boundary = {"type": "system", "subtype": "compact_boundary", "uuid": "b", "logicalParentUuid": "y19", "timestamp": "T", "compactMetadata": {"trigger": "manual", "preTokens": 100, "postTokens": 30, "durationMs": 5, "preservedSegment": {"head": "h"}}}
    summary = lambda i, up, content: {"type": "user", "uuid": i, "parentUuid": up, "isCompactSummary": True, "message": {"role": "user", "content": content}}
    rows = lines(spark, s=[
        {"type": "user", "uuid": "u", "message": {"role": "user", "content": "a"}}, *system, boundary,
        summary("m1", "b", "first"), summary("m2", "b", [{"type": "text", "text": "last"}, {"type": "image"}]),
        {**boundary, "uuid": "c", "logicalParentUuid": "unknown", "compactMetadata": {}}, summary("m3", "c", "  "),
        {**boundary, "uuid": "d", "logicalParentUuid": "r1"}, {"type": "system", "uuid": "r1", "parentUuid": "r2"}, {"type": "system", "uuid": "r2", "parentUuid": "r1"}, summary("m4", "d", ""),
        summary("m5", "elsewhere", "own"), summary("m6", "elsewhere", "own too"),
    ])
    got = N.claude(rows).compactions.orderBy("ordinal").collect()
    assert [(r.id, r.after_message_id, r.state, r.summary_status, r.summary_text, r.summary_message_id) for r in got] == [
        ("b", "u", "completed", "available", "last", "m2"),
        ("c", "unknown", "completed", "available", "  ", "m3"),
        ("d", None, "incomplete", "missing", None, "m4"),
        ("elsewhere", None, "completed", "available", "own", "m5"),
        ("elsewhere", None, "completed", "available", "own too", "m6"),
    ]
    assert got[0].metrics == {"pre_tokens": 100, "post_tokens": 30, "duration_ms": 5, "dropped_tokens": 70} and got[1].metrics == {}
    assert json.loads(got[0].source_meta) == {"preserved_segment": {"head": "h"}} and got[0].created == "T"
