"""Readers of transcript folders: one line per record, ends at line breaks only, tolerant of a torn last line."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clip
from ..operators.topology import active_branch

USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
CLAUDE = f"type string, uuid string, parentUuid string, cwd string, sessionId string, timestamp string, isSidechain boolean, title string, message struct<role:string,model:string,content:string,usage:{USAGE}>"
CODEX = "type string, timestamp string, payload string"
PI = "type string, id string, parentId string, timestamp string, cwd string, version int, name string, message struct<role:string,model:string,content:string,usage:struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, raw, size, modified_ms of every line below `path`. The order of a file's lines is that of
    its bytes: files are read whole, split at CR, LF or CRLF (never at other separators)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    files = files.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.unix_millis("_metadata.file_modification_time").alias("modified_ms"),
        "value"
    )
    rows = files.select(
        "file", "size", "modified_ms", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "raw")
    )
    return rows.where("trim(raw) <> ''")


def records(rows: DataFrame, schema: str) -> DataFrame:
    """Parsed records `r`; a line that is no JSON object has a null `r` and torn says whether it is its file's last."""
    last = F.max("line_no").over(Window.partitionBy("file"))
    ok = F.try_parse_json("raw")
    return rows.withColumn("r", F.when(ok.isNotNull(), F.from_json("raw", schema))).withColumn(
        "torn", F.col("r").isNull() & (F.col("line_no") == last)
    )


def _title(text) -> F.Column:
    return F.when(~F.startswith(F.ltrim(text), F.lit("<")) & ~F.startswith(F.ltrim(text), F.lit("[")), clip(text))


def _filled(c) -> F.Column:
    return F.nullif(F.col(c), F.lit(""))


def _objects(rows: DataFrame, schema: str) -> DataFrame:
    """Parsed records `r`, null for a line that is no JSON object."""
    return rows.withColumn("r", F.when(F.try_parse_json("raw").isNotNull(), F.from_json("raw", schema)))


PARTS = (
    ("input", "input_tokens"),
    ("output", "output_tokens"),
    ("cache_read", "cache_read_input_tokens"),
    ("cache_write", "cache_creation_input_tokens")
)


def _claude_records(rows: DataFrame) -> DataFrame:
    r = _objects(rows, CLAUDE).select(
        "file", "size", "modified_ms", "line_no", F.col("r").isNull().alias("broken"), "r.*"
    )
    model = F.col("message.model")
    counted = (F.col("type") == "assistant") & (F.coalesce(model, F.lit("")) != "") & (model != "<synthetic>")
    tokens = (F.when(counted, F.coalesce(F.col(f"message.usage.{c}"), F.lit(0))).alias(n) for n, c in PARTS)
    return r.select("*", F.when(counted, model).alias("used"), *tokens)


def claude_usage(rows: DataFrame) -> DataFrame:
    """(file, used, tokens, first) by model, first being the place of its first record. One fold: also for a stream."""
    r = _claude_records(rows).where("used is not null")
    spent = sum((F.col(n) for n, _ in PARTS[1:]), F.col("input"))
    return r.groupBy("file", "used").agg(F.sum(spent).alias("tokens"), F.min("line_no").alias("first"))


def claude_sessions(rows: DataFrame) -> DataFrame:
    """The session row of each file but its model, in one fold over its lines: as a stream (file, size, modified_ms,
    line_no, raw) is appended to, its rows follow without a line being read again."""
    r = _claude_records(rows)
    said = F.col("type").isin("user", "assistant")
    content = F.col("message.content")
    content = F.when((F.col("type") == "user") & ~F.startswith(F.ltrim(content), F.lit("[")), content)
    text = F.when((F.trim(content) != "") & ~F.startswith(F.trim(content), F.lit("<")), clip(content))
    generated = F.when((F.col("type") == "ai-title"), _filled("title"))
    place = F.when(said, _filled("cwd"))
    r = r.select("*", text.alias("asked"), generated.alias("generated"), place.alias("place"))
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    out = r.groupBy("file").agg(
        F.lit("claude").alias("tool"),
        F.max("size").alias("size"),
        F.max("modified_ms").alias("updated_ms"),
        F.count(F.when(said, 1)).alias("count"),
        F.coalesce(F.min_by("place", at("place")), F.lit("")).alias("dir"),
        F.min(F.when(said, F.unix_millis(F.try_to_timestamp("timestamp")))).alias("created_ms"),
        F.coalesce(F.max_by("generated", at("generated")), F.min_by("asked", at("asked")), F.lit("")).alias("title"),
        *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n, _ in PARTS),
        F.count(F.when(F.col("broken"), 1)).alias("broken"),
    )
    return out.where("count > 0 and broken = 0").drop("broken")


def claude_rows(rows: DataFrame, base: str = "") -> DataFrame:
    """One session row per file. Only user and assistant records count, give the first directory and the earliest
    time; tokens and the model of most tokens come from assistant records whose model is not synthetic. The title is
    the last one that was generated, else the first text of a user. The id is the file's name; below `base`, a file
    more than two levels deep is a child of the folder on the second level. A file with a line that is no JSON, or
    without messages, gives no row."""
    most = F.max_by("used", F.struct("tokens", (-F.col("first")).alias("early")))
    model = claude_usage(rows).groupBy("file").agg(most.alias("model"))
    root = re.sub("^file:/*", "/", base.rstrip("/"))
    below = F.replace(F.regexp_replace("file", "^file:/*", "/"), F.lit(root), F.lit(""))
    below = F.split(F.regexp_replace(below, "^/+", ""), "/")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    child = F.when((F.size(below) > 2) & F.lit(bool(base)), F.get(below, F.lit(1)))
    out = claude_sessions(rows).withColumn("id", stem).withColumn("parent_id", child)
    return out.withColumn("root_id", F.coalesce(child, stem)).join(model, "file", "left")


def codex_rows(rows: DataFrame) -> DataFrame:
    """One session row per file: the last cumulative usage wins; cached input is taken off, reasoning added. One fold
    over a file's lines: also for a stream that they are appended to."""
    r = _objects(rows, CODEX).where("r is not null").select(
        "file", "size", "modified_ms", "line_no", "r.type", "r.payload"
    )
    counts = "input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, reasoning_output_tokens bigint"
    r = r.withColumn("u", F.from_json(F.get_json_object("payload", "$.info.total_token_usage"), counts))
    of = lambda path: F.get_json_object("payload", path)
    message = (F.col("type") == "response_item") & (of("$.type") == "message")
    r = r.withColumn("title_text", _title(F.when(message & (of("$.role") == "user"), of("$.content[0].text"))))
    r = r.withColumn("said", message & of("$.role").isin("user", "assistant"))
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    out = r.groupBy("file").agg(
        F.lit("codex").alias("tool"),
        F.max("size").alias("size"),
        F.max("modified_ms").alias("updated_ms"),
        F.count(F.when(F.col("said"), 1)).alias("count"),
        F.min_by("title_text", at("title_text")).alias("title"),
        F.max_by("u", at("u")).alias("u"),
        F.min_by("payload", F.when(F.col("type") == "session_meta", F.col("line_no"))).alias("meta"),
    )
    n = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0))
    return out.select(
        "file",
        "tool",
        "size",
        "updated_ms",
        "count",
        "title",
        F.get_json_object("meta", "$.id").alias("id"),
        F.get_json_object("meta", "$.cwd").alias("dir"),
        F.greatest(F.lit(0), n("input_tokens") - n("cached_input_tokens")).alias("input"),
        (n("output_tokens") + n("reasoning_output_tokens")).alias("output"),
        n("cached_input_tokens").alias("cache_read"),
        F.lit(0).cast("long").alias("cache_write"),
    )


def codex_open_calls(rows: DataFrame) -> DataFrame:
    """(file, call_id, open): calls of a file and whether their output has not come yet. One fold: also for a stream,
    where a call that one batch opens is closed by another."""
    r = _objects(rows, CODEX).where("r.type = 'response_item'").select("file", "r.payload")
    kind = F.get_json_object("payload", "$.type")
    call = F.get_json_object("payload", "$.call_id")
    r = r.select(
        "file",
        call.alias("call_id"),
        kind.isin("function_call", "custom_tool_call").alias("asks"),
        kind.isin("function_call_output", "custom_tool_call_output").alias("answers")
    )
    out = r.where("call_id is not null and (asks or answers)").groupBy("file", "call_id").agg(
        F.max("asks").alias("asked"), F.max("answers").alias("answered")
    )
    return out.select("file", "call_id", (F.col("asked") & ~F.col("answered")).alias("open"))


def pi_rows(rows: DataFrame) -> DataFrame:
    """One session row per file of version 3. A torn last line is tolerated, any other bad line rejects its file.
    Only the active branch counts, from the last record that has an id and a parent field up to its root: messages of
    users, assistants and shell runs, tokens and the last model of assistants; the title is the last session name,
    else the first text of a user. A file without messages gives no row."""
    r = records(rows, PI)
    bad = r.where("r is null and not torn").select("file").distinct()
    linked = F.array_contains(F.json_object_keys("raw"), "parentId")
    r = r.where("r is not null").join(bad, "file", "left_anti").select(
        "file", "size", "modified_ms", "line_no", linked.alias("linked"), "r.*"
    )
    named = reduce(lambda a, b: a & b, [_filled(c).isNotNull() for c in ("id", "timestamp", "cwd")])
    first = F.min("line_no").over(Window.partitionBy("file"))
    head = r.withColumn("first", first).where("line_no = first and type = 'session' and version = 3").where(named)
    head = head.select(
        "file",
        F.col("id").alias("session"),
        F.col("cwd").alias("dir"),
        "size",
        F.col("modified_ms").alias("updated_ms"),
        F.unix_millis(F.try_to_timestamp("timestamp")).alias("created_ms")
    )
    r = r.where("linked and id is not null").join(head.select("file"), "file", "left_semi")
    branch = active_branch(r, "file", "id", "parentId", "line_no")
    r = r.groupBy("file", "id").agg(F.max_by(F.struct("type", "name", "message"), "line_no").alias("r"))
    r = r.join(branch, ["file", "id"]).select("file", "step", "r.*")
    text = F.coalesce(F.get_json_object("message.content", "$[0].text"), F.col("message.content"))
    asked = F.when((F.col("message.role") == "user") & (F.trim(text) != ""), clip(text))
    message, said = F.col("type") == "message", F.col("message.role") == "assistant"
    r = r.select(
        "*",
        F.when(message, asked).alias("asked"),
        F.when(F.col("type") == "session_info", _filled("name")).alias("title"),
        F.when(message & said, _filled("message.model")).alias("model")
    )
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("step"))
    parts = (("input", "input"), ("output", "output"), ("cache_read", "cacheRead"), ("cache_write", "cacheWrite"))
    out = r.groupBy("file").agg(
        F.lit("pi").alias("tool"),
        F.count(F.when(message & F.col("message.role").isin("user", "assistant", "bashExecution"), 1)).alias("count"),
        F.coalesce(F.max_by("title", at("title")), F.min_by("asked", at("asked")), F.lit("")).alias("title"),
        F.coalesce(F.max_by("model", at("model")), F.lit("")).alias("model"),
        *(F.coalesce(F.sum(F.when(message & said, F.col(f"message.usage.{c}"))), F.lit(0)).alias(n) for n, c in parts),
    )
    return out.where("count > 0").join(head, "file").withColumnRenamed("session", "id")


def blocks(rows: DataFrame, schema: str = CLAUDE) -> DataFrame:
    """The content blocks of message records: text as one block, an array of blocks exploded in order."""
    r = records(rows, schema).where("r.message is not null").select("file", "line_no", "r.message.*")
    parts = F.from_json(
        "content",
        "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>"
    )
    many = F.when(F.startswith(F.ltrim("content"), F.lit("[")), parts)
    plain = F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.col("content").alias("text"),
            *(
                F.lit(None).cast(t).alias(n) for n,
                t in (
                    ("thinking", "string"),
                    ("id", "string"),
                    ("name", "string"),
                    ("input", "string"),
                    ("tool_use_id", "string"),
                    ("is_error", "boolean"),
                    ("content", "string")
                )
            )
        )
    )
    return r.select(
        "file", "line_no", "role", "model", F.posexplode(F.coalesce(many, plain)).alias("block_idx", "b")
    ).select("file", "line_no", "role", "model", "block_idx", "b.*")


def new_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (file, modified_ms, size) the manifest does not hold."""
    return found.select("file", "modified_ms", "size").distinct().join(
        manifest, ["file", "modified_ms", "size"], "left_anti"
    )
