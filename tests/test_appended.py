"""Session rows that follow appended lines: any cut into batches gives the rows of the whole."""

import json
import os

import pytest

from quern.sources import transcripts as T

LINES = "file string, line_no long, raw string, size long, modified_ms long"


def item(**payload):
    return json.dumps({"type": "response_item", "payload": payload})


def codex():
    used = lambda n: json.dumps({"type": "event_msg", "payload": {"info": {"total_token_usage": {"input_tokens": n, "cached_input_tokens": n // 2, "output_tokens": 3, "reasoning_output_tokens": 1}}}})
    return [
        json.dumps({"type": "session_meta", "payload": {"id": "x", "cwd": "/w"}}),
        item(type="message", role="user", content=[{"text": "<skip>"}]),
        item(type="message", role="user", content=[{"text": "the title"}]),
        used(10), item(type="function_call", call_id="a", name="shell"), item(type="function_call", call_id="b", name="shell"), used(40),
        item(type="function_call_output", call_id="a", output="ok"), item(type="message", role="assistant", content=[{"text": "done"}]), used(90), "{torn",
    ]


def claude():
    say = lambda kind, **m: json.dumps({"type": kind, "cwd": "/p", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": kind, **m}})
    use = lambda model, n: say("assistant", model=model, content="x", usage={"input_tokens": n, "output_tokens": 1})
    return [say("user", content="hello there"), use("m1", 5), use("m2", 9), json.dumps({"type": "ai-title", "title": "named"}), use("m1", 5), use("<synthetic>", 99)]


def table():
    return [(name, k, raw, k, 7) for name, raws in (("/a/c.jsonl", codex()), ("/a/d.jsonl", codex()[:6])) for k, raw in enumerate(raws)]


def streamed(spark, tmp_path, rows, cut, fold, name):
    path = tmp_path / name
    path.mkdir()
    for n, lo in enumerate(range(0, len(rows), cut)):
        part = path / f"{n:04d}.json"
        part.write_text("\n".join(json.dumps(dict(zip(("file", "line_no", "raw", "size", "modified_ms"), r, strict=True))) for r in rows[lo : lo + cut]))
        os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).json(f"file://{path}")
    query = fold(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    query.option("checkpointLocation", f"file://{tmp_path}/{name}-at").start().awaitTermination(300)
    return sorted(map(str, spark.table(name).collect()))


@pytest.mark.parametrize("cut", [1, 4])
def test_codex_rows_follow_appended_lines(spark, tmp_path, cut):
    rows = sorted(table(), key=lambda r: r[1])
    whole = spark.createDataFrame(rows, LINES)
    want = T.codex_rows(whole)
    got = {r.file: (r["count"], r.title, r.id, r.input, r.output, r.cache_read) for r in want.collect()}
    assert got == {"/a/c.jsonl": (3, "the title", "x", 45, 4, 45), "/a/d.jsonl": (2, "the title", "x", 5, 4, 5)}
    assert streamed(spark, tmp_path, rows, cut, T.codex_rows, f"codex{cut}") == sorted(map(str, want.collect()))
    calls = T.codex_open_calls(whole)
    assert {(r.file[3], r.call_id, r.open) for r in calls.collect()} == {("c", "a", False), ("c", "b", True), ("d", "a", True), ("d", "b", True)}
    assert streamed(spark, tmp_path, rows, cut, T.codex_open_calls, f"calls{cut}") == sorted(map(str, calls.collect()))


def test_claude_rows_follow_appended_lines(spark, tmp_path):
    rows = [("/b/s.jsonl", k, raw, k, 7) for k, raw in enumerate(claude())] + [("/b/t.jsonl", 0, claude()[0], 0, 7), ("/b/t.jsonl", 1, "{bad", 1, 7)]
    whole = spark.createDataFrame(rows, LINES)
    one = T.claude_rows(whole).collect()
    assert [(r.id, r["count"], r.title, r.dir, r.input, r.output, r.model) for r in one] == [("s", 5, "named", "/p", 19, 3, "m1")]
    assert streamed(spark, tmp_path, rows, 2, T.claude_sessions, "claude2") == sorted(map(str, T.claude_sessions(whole).collect()))
    assert streamed(spark, tmp_path, rows, 2, T.claude_usage, "usage2") == sorted(map(str, T.claude_usage(whole).collect()))
