"""Native records of each format to one set of tables: messages, blocks, losses, compactions.

blocks: session, message_idx (from 1), block_idx (from 0), role, source_id, parent_id, created, kind (text, thinking,
image, tool), text, name, op, call_id, input, status, output. messages: one row per message of blocks. losses: session,
code, detail. compactions: session, ordinal, id, after_message_id, trigger, state, summary_status, summary_text,
summary_message_id, replaces, and metrics (a map of token counts and durations) where the format has any. A session is its file. Readers are joins and windows by session; a null or torn line is a
loss, an empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import IMAGE_TYPES, image_of, patch_changes, result_status, visible_text
from ..operators import dialects
from ..operators.topology import active_branch, settled
from ..operators.turns import pair_calls

#: How texts begin that a tool put into the user's place.
INJECTED = ("<environment_context>", "<user_instructions>", "<ENVIRONMENT_CONTEXT>", "<turn_aborted>")
_WIDE = 1 << 20


@dataclass
class Tables:
    messages: DataFrame
    blocks: DataFrame
    losses: DataFrame
    compactions: DataFrame | None = None


def _json(c: str | Column, path: str) -> Column:
    return F.get_json_object(c, path)


def _kind_at(raw: str | Column, path: str) -> Column:
    """STRING, BIGINT, ARRAY<...>, OBJECT<...> or null of what a JSON text holds at a path."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant"))


def _is_object(raw: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(raw)), F.lit("OBJECT<")), F.lit(False))


def _loss(rows: DataFrame, code: str, detail: Column) -> DataFrame:
    return rows.select("session", F.lit(code).alias("code"), detail.cast("string").alias("detail"))


def _plain_output(content: Column) -> Column:
    """Text of a result: a JSON string's or list's text parts, anything else as it stands."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")
    return F.when(F.startswith(F.ltrim(content), F.lit("[")) & parts.isNotNull(), texts).otherwise(content)


def _finished(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers messages by (at, sub) and blocks by `part` within them."""
    of = Window.partitionBy("session")
    number = F.dense_rank().over(of.orderBy("at", "sub")).cast("long")
    place = (F.row_number().over(Window.partitionBy("session", "at", "sub").orderBy("part")) - 1).cast("long")
    columns = (
        "role",
        "source_id",
        "parent_id",
        "created",
        "kind",
        "text",
        "name",
        "op",
        "call_id",
        "input",
        "status",
        "output"
    )
    out = blocks.select("session", number.alias("message_idx"), place.alias("block_idx"), *columns)
    first = [F.min_by(c, "block_idx").alias(c) for c in columns[:4]]
    return out.groupBy("session", "message_idx").agg(*first, F.count(F.lit(1)).alias("blocks")), out


def _paired(blocks: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool blocks with status and output of their results, and the losses of what has no partner. Results: session,
    call_id, ordinal, status, output."""
    calls = blocks.where("kind = 'tool'").select("session", "call_id", "name", F.col("ordinal"))
    pairs = pair_calls(calls, results, ["session", "call_id"])
    lost = _loss(pairs.where("state = 'orphan_result'"), "session.orphan_tool_result", F.col("call_id"))
    lost = lost.unionByName(_loss(pairs.where("state = 'unpaired_call'"), "session.unpaired_tool_use", F.col("name")))
    known = pairs.where("state = 'paired'").select("session", F.col("call_at").alias("ordinal"), "status", "output")
    return blocks.join(known, ["session", "ordinal"], "left"), lost


def _block(kind: str | Column, text: Column | None = None, **fields: Column) -> list[Column]:
    none = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [
        kind.alias("kind"),
        (text if text is not None else none).alias("text"),
        *(fields.get(c, none).alias(c) for c in ("name", "op", "call_id", "input"))
    ]


CLAUDE = "type string, subtype string, uuid string, parentUuid string, logicalParentUuid string, sessionId string, timestamp string, isSidechain boolean, isMeta boolean, isCompactSummary boolean, compactMetadata string, toolUseResult string, message struct<role:string,content:string>"
_PARTS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string,source:struct<media_type:string,data:string>>>"


def claude(rows: DataFrame, child: bool = False) -> Tables:
    """Lines (file, line_no, raw). Side chains are left out of a parent's file; a message that only carries results is
    no message; thinking becomes text; the n-th call of an id meets its n-th result."""
    r = rows.select(
        F.col("file").alias("session"),
        F.col("line_no").cast("long").alias("at"),
        "raw",
        F.when(_is_object("raw"), F.from_json("raw", CLAUDE)).alias("r")
    )
    losses = _loss(r.where("r is null"), "session.malformed_record", F.col("at") + 1)
    r = r.where("r is not null")
    said = r.where(F.col("r.type").isin("user", "assistant") & ~F.coalesce(F.col("r.isMeta"), F.lit(False)))
    said = said if child else said.where(~F.coalesce(F.col("r.isSidechain"), F.lit(False)))
    text = _kind_at("raw", "$.message.content") == "STRING"
    one = F.from_json(
        F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("r.message.content").alias("text")))), _PARTS
    )
    items = said.select(
        "session",
        "at",
        F.col("r.message.role").alias("role"),
        F.col("r.uuid").alias("source_id"),
        F.col("r.parentUuid").alias("parent_id"),
        F.col("r.timestamp").alias("created"),
        F.col("r.toolUseResult").alias("native"),
        text.alias("plain"),
        F.posexplode(F.when(text, one).otherwise(F.from_json("r.message.content", _PARTS))).alias("part", "b")
    )
    items = items.withColumn("ordinal", F.col("at") * _WIDE + F.col("part")).withColumn("sub", F.lit(0))
    kind, thought = F.col("b.type"), visible_text(F.col("b.thinking"))
    image = F.col("b.source.media_type").isin(*IMAGE_TYPES) & F.col("b.source.data").rlike("^[A-Za-z0-9+/]+={0,2}$")
    op, canonical = dialects.parse("claude", F.col("b.name"), F.coalesce("b.input", F.lit("{}")))
    shown = F.when(kind == "text", "text").when(
        (kind == "thinking") & thought.isNotNull(), "text"
    ).when((kind == "image") & image, "image").when(kind == "tool_use", "tool")
    words = F.when(kind == "text", F.coalesce("b.text", F.lit(""))).when(kind == "thinking", thought)
    tool = kind == "tool_use"
    blocks = items.select(
        "session",
        "at",
        "sub",
        "part",
        "ordinal",
        "role",
        "source_id",
        "parent_id",
        "created",
        "plain",
        (kind == "tool_result").alias("carries"),
        *_block(
            shown,
            words,
            name=F.when(tool, F.col("b.name")),
            op=F.when(tool, op),
            call_id=F.when(tool, F.col("b.id")),
            input=F.when(tool, canonical)
        )
    )
    w = Window.partitionBy("session", "at")
    blocks = blocks.withColumn("carrier", F.max("carries").over(w)).withColumn(
        "speaks", F.max(F.coalesce((F.col("kind") == "text") & (F.trim("text") != ""), F.lit(False))).over(w)
    )
    failed = F.coalesce(F.col("b.is_error"), F.lit(False)) | F.coalesce(
        _json("native", "$.success") == "false", F.lit(False)
    )
    state = result_status(
        "claude", _json("native", "$.status"), failed, _json("native", "$.interrupted") == "true", F.lit(0)
    )
    results = items.where("b.type = 'tool_result'").select(
        "session",
        F.col("b.tool_use_id").alias("call_id"),
        "ordinal",
        state.alias("status"),
        _plain_output(F.col("b.content")).alias("output")
    )
    paired, unpaired = _paired(blocks.where("kind is not null"), results)
    unknown = items.where(
        (kind == "image") & ~F.coalesce(image, F.lit(False)) | ~kind.isin(
            "text", "thinking", "image", "tool_use", "tool_result"
        )
    )
    thoughts = items.where("b.type = 'thinking'")
    losses = losses.unionByName(unpaired).unionByName(
        _loss(unknown, "migration.unknown_block_dropped", F.col("b.type"))
    )
    losses = losses.unionByName(
        _loss(thoughts.where(thought.isNotNull()), "migration.reasoning_metadata_dropped", F.lit("signature"))
    )
    losses = losses.unionByName(
        _loss(thoughts.where(thought.isNull()), "migration.reasoning_dropped", F.lit("signature"))
    )
    messages, out = _finished(paired.where("not carrier or speaks"))
    return Tables(messages, out, losses, _claude_compactions(r))


def _claude_compactions(r: DataFrame) -> DataFrame:
    """Boundaries and summaries. Of the summaries that name a boundary as their parent the last is its own; one whose
    parent is no boundary is a compaction by itself. An anchor is walked up, however far, to a record that is shown: the
    way through records that are not is halved each round, and an anchor that runs in a circle is null."""
    base = r.select("session", "at", F.col("r.uuid").alias("id"), F.col("r.parentUuid").alias("up"), "r.*", "raw")
    said = F.coalesce("isCompactSummary", F.lit(False))
    meta = lambda name: F.try_variant_get(F.try_parse_json("compactMetadata"), f"$.{name}", "variant")
    number = lambda name: F.when(F.schema_of_variant(meta(name)) == "BIGINT", meta(name).cast("bigint"))
    gone = number("preTokens") - number("postTokens")
    lost = F.when(gone.isNotNull(), F.greatest(F.lit(0), gone))
    measured = {
        "pre_tokens": number("preTokens"),
        "post_tokens": number("postTokens"),
        "cumulative_dropped_tokens": number("cumulativeDroppedTokens"),
        "duration_ms": number("durationMs"),
        "dropped_tokens": lost
    }
    segment = F.to_json(
        F.struct(
            meta("preservedSegment").alias("preserved_segment"), meta("preservedMessages").alias("preserved_messages")
        )
    )
    end = base.where("subtype = 'compact_boundary' and type = 'system'")
    end = end.select(
        "session",
        F.col("at").alias("ordinal"),
        F.coalesce("uuid", F.concat(F.lit("compact-boundary:"), "at")).alias("id"),
        F.col("logicalParentUuid").alias("anchor"),
        _json("compactMetadata", "$.trigger").alias("trigger"),
        F.col("timestamp").alias("created"),
        _metrics(measured),
        F.nullif(segment, F.lit("{}")).alias("source_meta")
    )
    parts = F.filter(
        F.from_json("message.content", "array<struct<type:string,text:string>>"),
        lambda p: (p["type"] == "text") & (p["text"] != "")
    )
    listed = F.coalesce(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), F.lit(""))
    content = F.when(_kind_at("raw", "$.message.content") == "STRING", F.col("message.content")).otherwise(listed)
    text = base.where(said).select(
        "session",
        F.col("at").alias("said_at"),
        F.col("parentUuid").alias("of"),
        F.coalesce("parentUuid", "uuid", F.concat(F.lit("compact-summary:"), "at")).alias("own_id"),
        F.col("uuid").alias("summary_message_id"),
        F.col("logicalParentUuid").alias("own_anchor"),
        F.col("timestamp").alias("own_created"),
        content.alias("summary_text")
    )
    # of boundaries that share an id the last has the summary
    named = end.groupBy("session", F.col("id").alias("of")).agg(F.max("ordinal").alias("ordinal"))
    text = text.join(named, ["session", "of"], "left")
    last = text.where("ordinal is not null").groupBy("session", "ordinal").agg(
        F.max_by(F.struct("summary_message_id", "summary_text"), "said_at").alias("s")
    ).select("session", "ordinal", "s.*")
    alone = text.where("ordinal is null").select(
        "session",
        F.col("said_at").alias("ordinal"),
        F.col("own_id").alias("id"),
        F.col("own_anchor").alias("anchor"),
        F.col("own_created").alias("created"),
        "summary_message_id",
        "summary_text"
    )
    c = end.join(last.withColumn("_said", F.lit(True)), ["session", "ordinal"], "left")
    c = c.unionByName(alone.withColumn("_said", F.lit(True)), allowMissingColumns=True)
    shown = F.col("type").isin("user", "assistant") & ~said
    latest = base.where("uuid is not null").groupBy("session", F.col("uuid").alias("_id")).agg(
        F.max_by(F.struct("up", F.coalesce(shown, F.lit(False)).alias("shown")), "at").alias("r")
    )
    place = lambda name: F.when(F.col(name).isNotNull(), F.struct("session", F.col(name).alias("id")))
    hidden = latest.where("not r.shown").select("session", "_id", F.col("r.up").alias("_up")).select(
        place("_id").alias("node"), place("_up").alias("up")
    )
    ways = settled(hidden).select(
        F.col("node.session").alias("session"),
        F.col("node.id").alias("anchor"),
        F.col("up.id").alias("_up"),
        F.lit(True).alias("_hidden")
    )
    c = c.join(ways, ["session", "anchor"], "left").withColumn(
        "anchor", F.when(F.col("_hidden"), F.col("_up")).otherwise(F.col("anchor"))
    )
    trigger = F.when(
        F.col("trigger") == "auto", "automatic"
    ).when(F.col("trigger") == "manual", "manual").otherwise("unknown")
    filled = F.coalesce(F.col("_said") & (F.col("summary_text") != ""), F.lit(False))
    status = F.when(filled, "available").otherwise("missing")
    return c.select(
        "session",
        "ordinal",
        "id",
        F.col("anchor").alias("after_message_id"),
        trigger.alias("trigger"),
        F.when(filled, "completed").otherwise("incomplete").alias("state"),
        status.alias("summary_status"),
        F.when(filled, F.col("summary_text")).alias("summary_text"),
        "summary_message_id",
        F.lit(True).alias("replaces"),
        F.coalesce("metrics", _metrics({})).alias("metrics"),
        "source_meta",
        "created"
    )


def _metrics(values: dict[str, Column]) -> Column:
    """A map of the measures that are there."""
    entries = [
        F.struct(F.lit(name).alias("key"), value.cast("bigint").alias("value")) for name, value in values.items()
    ]
    if not entries:
        return F.create_map().cast("map<string,bigint>").alias("metrics")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull())).alias("metrics")


CODEX = "type string, timestamp string, payload string"


def codex(rows: DataFrame) -> Tables:
    """Lines of a rollout. Calls and reasoning wait for the next assistant message; a user's message before that closes
    them into an assistant message of their own, as does the end of the file."""
    r = rows.select(
        F.col("file").alias("session"),
        F.col("line_no").cast("long").alias("at"),
        F.when(_is_object("raw"), F.from_json("raw", CODEX)).alias("r")
    )
    losses = _loss(r.where("r is null"), "session.malformed_record", F.col("at") + 1)
    w = Window.partitionBy("session").orderBy("at")
    r = r.where("r is not null").withColumn("record", F.row_number().over(w) - 1).select(
        "session",
        "at",
        "record",
        F.col("r.timestamp").alias("created"),
        F.col("r.type").alias("type"),
        F.col("r.payload").alias("p")
    )
    items = r.where("type = 'response_item'").withColumn(
        "kind", _json("p", "$.type")
    ).withColumn("role", _json("p", "$.role"))
    parts = F.from_json(_json("p", "$.content"), "array<struct<type:string,text:string,image_url:string>>")
    listed = F.startswith(_kind_at("p", "$.content"), F.lit("ARRAY"))
    words = F.array_join(
        F.transform(
            F.filter(parts, lambda x: x["type"].isin("input_text", "output_text") & (x["text"] != "")),
            lambda x: x["text"]
        ),
        "\n"
    )
    text = F.when(listed, words).otherwise(_json("p", "$.content"))
    items = items.withColumn("text", F.when(F.col("kind") == "message", F.coalesce(text, F.lit("")))).withColumn(
        "images", F.when((F.col("kind") == "message") & listed, F.filter(parts, lambda x: x["type"] == "input_image"))
    )
    injected = F.lit(False)
    for start in INJECTED:
        injected = injected | F.startswith(F.ltrim("text"), F.lit(start))
    items = items.where(~((F.col("kind") == "message") & (F.col("role") == "user") & injected))
    closing = (F.col("kind") == "message") & F.col("role").isin("user", "assistant")
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    edge = F.when(closing, F.struct("at", "role", "record", "created"))
    items = items.withColumn("owner", F.first(edge, ignorenulls=True).over(ahead)).withColumn(
        "end", F.max("at").over(Window.partitionBy("session")) + 1
    )
    thought = visible_text(
        F.array_join(
            F.transform(F.from_json(_json("p", "$.summary"), "array<struct<text:string>>"), lambda x: x["text"]), "\n"
        )
    )
    call = F.col("kind").isin("function_call", "custom_tool_call")
    waiting = items.where(call | (F.col("kind") == "reasoning") & thought.isNotNull())
    by_user = F.col("owner.role") == "user"
    source = F.concat(F.lit("record:"), F.col("owner.record"))
    op, canonical = dialects.parse(
        "codex", _json("p", "$.name"), F.coalesce(_json("p", "$.arguments"), _json("p", "$.input"), F.lit("{}"))
    )
    given = F.coalesce(_json("p", "$.arguments"), _json("p", "$.input"))
    patch = F.when(
        _json("p", "$.name") == "apply_patch", F.coalesce(_json(given, "$.patch"), _json(given, "$.input"), given)
    )
    changed = F.size(patch_changes(patch)) > 0
    changes = F.transform(
        patch_changes(patch),
        lambda c: F.struct(
            c["operation"].alias("operation"),
            c["path"].alias("path"),
            c["destination"].alias("destination"),
            c["hunks"].alias("hunk_count")
        )
    )
    op = F.when(changed, "fs.patch").otherwise(op)
    canonical = F.when(
        changed, F.to_json(F.struct(changes.alias("operations"), patch.alias("raw_patch")))
    ).otherwise(canonical)
    none = F.lit(None).cast("string").alias("parent_id")
    held = waiting.select(
        "session",
        F.coalesce("owner.at", "end").alias("at"),
        F.when(by_user | F.col("owner").isNull(), 0).otherwise(1).alias("sub"),
        (F.when(call, 1).otherwise(0) * F.lit(_WIDE**2) + F.col("at")).alias("part"),
        F.col("at").alias("ordinal"),
        F.lit("assistant").alias("role"),
        source.alias("source_id"),
        none,
        F.col("owner.created").alias("created"),
        *_block(
            F.when(call, "tool").otherwise("text"),
            F.when(~call, thought),
            name=F.when(call, _json("p", "$.name")),
            op=F.when(call, op),
            call_id=F.when(call, _json("p", "$.call_id")),
            input=F.when(call, canonical)
        )
    )
    own = items.where("kind = 'message'")
    at = ["session", "at", F.lit(1).alias("sub")]
    who = ["role", F.concat(F.lit("record:"), "record").alias("source_id"), none, "created"]
    late = F.lit(2 * _WIDE**2)
    spoken = own.where("trim(text) <> ''").select(
        *at, late.alias("part"), (-F.col("at") - 1).alias("ordinal"), *who, *_block("text", F.col("text"))
    )
    pictures = own.select(
        "session", "at", "record", "role", "created", F.posexplode("images").alias("n", "i")
    ).withColumn("good", image_of(F.col("i.image_url")).isNotNull())
    seen = pictures.where("good").select(
        *at, (late + 1 + F.col("n")).alias("part"), (-F.col("at") - 1).alias("ordinal"), *who, *_block("image")
    )
    results = items.where(F.col("kind").isin("function_call_output", "custom_tool_call_output"))
    output = _json("p", "$.output")
    state = result_status(
        "claude", F.coalesce(_json(output, "$.status"), F.lit(None)), F.lit(False), F.lit(False), F.lit(0)
    )
    coded = F.coalesce(_json(output, "$.metadata.exit_code"), F.lit("0")) != "0"
    results = results.select(
        "session",
        _json("p", "$.call_id").alias("call_id"),
        F.col("at").alias("ordinal"),
        F.when(coded, "error").otherwise(state).alias("status"),
        F.coalesce(_json(output, "$.output"), _plain_output(output)).alias("output")
    )
    paired, unpaired = _paired(held.unionByName(spoken).unionByName(seen), results)
    reasoning = items.where("kind = 'reasoning'")
    known = (
        "message", "reasoning", "function_call", "custom_tool_call", "function_call_output", "custom_tool_call_output"
    )
    losses = losses.unionByName(unpaired.where("code = 'session.orphan_tool_result'"))
    losses = losses.unionByName(
        _loss(items.where(~F.col("kind").isin(*known)), "migration.unknown_block_dropped", F.col("kind"))
    )
    losses = losses.unionByName(
        _loss(pictures.where("not good"), "migration.unknown_block_dropped", F.lit("input_image"))
    )
    losses = losses.unionByName(
        _loss(reasoning.where(thought.isNotNull()), "migration.reasoning_metadata_dropped", F.lit("encrypted_content"))
    )
    losses = losses.unionByName(
        _loss(reasoning.where(thought.isNull()), "migration.reasoning_dropped", F.lit("encrypted_content"))
    )
    messages, out = _finished(paired)
    return Tables(messages, out, losses, _codex_compactions(r, messages))


def _codex_compactions(r: DataFrame, messages: DataFrame) -> DataFrame:
    c = r.where("type = 'compacted'").withColumn("summary_text", F.trim(F.coalesce(_json("p", "$.message"), F.lit(""))))
    # the last message before it: messages are known by their records
    at = messages.where("source_id is not null").select(
        "session", F.substring("source_id", 8, 20).cast("long").alias("_n"), "source_id"
    )
    before = c.select("session", "record").join(at, "session").where("_n < record").groupBy("session", "record").agg(
        F.max_by("source_id", "_n").alias("after_message_id")
    )
    replaced = _json("p", "$.replacement_history")
    items = F.from_json(replaced, "array<struct<type:string,encrypted_content:string>>")
    secret = F.exists(
        F.coalesce(items, F.array().cast("array<struct<type:string,encrypted_content:string>>")),
        lambda x: (x["type"] == "compaction") & (x["encrypted_content"] != "")
    )
    status = F.when(F.col("summary_text") != "", "available").when(secret, "protected").otherwise("missing")
    name = F.coalesce(_json("p", "$.window_id"), F.concat(F.lit("record:"), "record"))
    out = c.join(before, ["session", "record"], "left")
    return out.select(
        "session",
        F.col("record").cast("long").alias("ordinal"),
        name.alias("id"),
        "after_message_id",
        F.lit("unknown").alias("trigger"),
        F.lit("completed").alias("state"),
        status.alias("summary_status"),
        F.nullif("summary_text", F.lit("")).alias("summary_text"),
        F.lit(None).cast("string").alias("summary_message_id"),
        (F.coalesce(F.size(items), F.lit(0)) > 0).alias("replaces")
    )


PI = "type string, id string, parentId string, timestamp string, summary string, firstKeptEntryId string, tokensBefore bigint, message struct<role:string,content:string,output:string,command:string,cancelled:boolean,exitCode:bigint,toolCallId:string,isError:boolean>"
_PI_PARTS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,arguments:string,mimeType:string,data:string>>"


def pi(rows: DataFrame) -> Tables:
    """Lines of version 3. Only the active branch is read; shell runs of the user become tool calls with their result,
    branch summaries become user messages."""
    w = Window.partitionBy("session")
    r = rows.select(
        F.col("file").alias("session"),
        F.col("line_no").cast("long").alias("at"),
        "raw",
        F.when(_is_object("raw"), F.from_json("raw", PI)).alias("r")
    )
    r = r.withColumn("first", F.min("at").over(w)).withColumn("last", F.max("at").over(w))
    losses = _loss(r.where("r is null and at < last"), "session.malformed_record", F.col("at") + 1)
    linked = F.array_contains(F.json_object_keys("raw"), "parentId")
    entries = r.where("r is not null and at > first").select("session", "at", "raw", "r.*").withColumn("linked", linked)
    branch = active_branch(entries.where("linked and id is not null"), "session", "id", "parentId", "at")
    known = entries.where("id is not null").join(branch.select("session", "id"), ["session", "id"], "left_anti")
    losses = losses.unionByName(
        _loss(known, "migration.unknown_block_dropped", F.concat(F.lit("inactive_branch "), "id"))
    )
    latest = entries.where("linked and id is not null").groupBy("session", "id").agg(
        F.max_by(
            F.struct("raw", "type", "parentId", "timestamp", "summary", "firstKeptEntryId", "tokensBefore", "message"),
            "at"
        ).alias("e")
    )
    e = latest.join(branch, ["session", "id"]).select("session", "id", F.col("step").alias("at"), "e.*")
    role, message = F.col("message.role"), F.col("type") == "message"
    plain = _kind_at("raw", "$.message.content") == "STRING"
    one = F.from_json(
        F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("message.content").alias("text")))), _PI_PARTS
    )
    who = [F.col("id").alias("source_id"), F.col("parentId").alias("parent_id"), F.col("timestamp").alias("created")]
    items = e.where(message & role.isin("user", "assistant")).select(
        "session",
        "at",
        role.alias("role"),
        *who,
        F.posexplode(F.when(plain, one).otherwise(F.from_json("message.content", _PI_PARTS))).alias("part", "b")
    )
    items = items.withColumn("ordinal", F.col("at") * _WIDE + F.col("part")).withColumn("sub", F.lit(0))
    kind = F.col("b.type")
    tool = (kind == "toolCall") & (F.col("role") == "assistant")
    image = F.col("b.mimeType").isin(*IMAGE_TYPES) & F.col("b.data").rlike("^[A-Za-z0-9+/]+={0,2}$")
    op, canonical = dialects.parse("pi", F.col("b.name"), F.coalesce("b.arguments", F.lit("{}")))
    shown = F.when(kind.isin("text", "thinking"), kind).when(tool, "tool").when((kind == "image") & image, "image")
    words = F.when(kind == "text", F.coalesce("b.text", F.lit(""))).when(
        kind == "thinking", F.coalesce("b.thinking", F.lit(""))
    )
    base = ["session", "at", "sub", "part", "ordinal", "role", "source_id", "parent_id", "created"]
    blocks = items.select(
        *base,
        *_block(
            shown,
            words,
            name=F.when(tool, F.col("b.name")),
            op=F.when(tool, op),
            call_id=F.when(tool, F.col("b.id")),
            input=F.when(tool, canonical)
        )
    ).where("kind is not null")
    alone = [
        "session",
        "at",
        F.lit(0).alias("sub"),
        F.lit(0).alias("part"),
        (F.col("at") * _WIDE).alias("ordinal"),
        F.lit("user").alias("role"),
        *who
    ]
    summaries = e.where("type = 'branch_summary'").select(*alone, *_block("text", F.coalesce("summary", F.lit(""))))
    ran = e.where(message & (role == "bashExecution"))
    command = F.to_json(F.struct(F.coalesce("message.command", F.lit("")).alias("command")))
    call_id = F.concat(F.lit("bash:"), "id")
    shells = ran.select(
        *alone, *_block("tool", name=F.lit("bash"), op=F.lit("shell.exec"), call_id=call_id, input=command)
    )
    done = F.when(
        F.coalesce("message.cancelled", F.lit(False)), "interrupted"
    ).when(F.coalesce("message.exitCode", F.lit(0)) != 0, "error").otherwise("success")
    given = e.where(message & (role == "toolResult"))
    results = ran.select(
        "session",
        call_id.alias("call_id"),
        (F.col("at") * _WIDE + 1).alias("ordinal"),
        done.alias("status"),
        F.coalesce("message.output", F.lit("")).alias("output")
    )
    results = results.unionByName(
        given.select(
            "session",
            F.col("message.toolCallId").alias("call_id"),
            (F.col("at") * _WIDE).alias("ordinal"),
            F.when(F.coalesce("message.isError", F.lit(False)), "error").otherwise("success").alias("status"),
            _plain_output(F.col("message.content")).alias("output")
        )
    )
    paired, unpaired = _paired(blocks.unionByName(summaries).unionByName(shells), results)
    odd = e.where(
        ~F.col("type").isin(
            "session_info", "model_change", "branch_summary", "compaction", "message", "thinking_level_change", "label"
        )
    )
    losses = losses.unionByName(unpaired).unionByName(_loss(odd, "migration.unknown_block_dropped", F.col("type")))
    losses = losses.unionByName(
        _loss(
            e.where(message & ~role.isin("user", "assistant", "bashExecution", "toolResult")),
            "migration.unknown_block_dropped",
            F.concat(F.lit("message."), role)
        )
    )
    messages, out = _finished(paired)
    shown_id = F.when(
        F.col("type").isin("branch_summary", "message") & ~F.coalesce(role == "toolResult", F.lit(False)), F.col("id")
    )
    c = e.withColumn(
        "after_message_id",
        F.last(shown_id, ignorenulls=True).over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    ).where("type = 'compaction'")
    filled = F.coalesce(F.col("summary") != "", F.lit(False))
    c = c.select(
        "session",
        F.col("at").alias("ordinal"),
        "id",
        "after_message_id",
        F.lit("unknown").alias("trigger"),
        F.lit("completed").alias("state"),
        F.when(filled, "available").otherwise("missing").alias("summary_status"),
        F.when(filled, F.col("summary")).alias("summary_text"),
        F.lit(None).cast("string").alias("summary_message_id"),
        F.lit(False).alias("replaces"),
        _metrics({"tokens_before": F.col("tokensBefore")})
    )
    return Tables(messages, out, losses, c)


def database(message: DataFrame, part: DataFrame) -> Tables:
    """Rows of a message table and a part table (id, session_id, message_id, data as JSON, time_created), parts in the
    order of their time and id. Reasoning becomes text; a call holds its own result."""
    w = Window.partitionBy("session_id").orderBy("time_created", "id")
    m = message.select(
        F.col("session_id").alias("session"),
        F.row_number().over(w).cast("long").alias("at"),
        F.col("id").alias("source_id"),
        F.coalesce(_json("data", "$.role"), F.lit("user")).alias("role"),
        _json("data", "$.parentID").alias("parent_id"),
        _json("data", "$.time.created").alias("created"),
        ((_json("data", "$.mode") == "compaction") | (_json("data", "$.summary") == "true")).alias("summary")
    )
    p = part.select(
        F.col("session_id").alias("session"), F.col("message_id").alias("source_id"), "id", "time_created", "data"
    )
    inner = Window.partitionBy("session", "source_id").orderBy("time_created", "id")
    items = p.withColumn(
        "part", F.row_number().over(inner) - 1
    ).join(m, ["session", "source_id"]).withColumn("kind", _json("data", "$.type"))
    kind, thought = F.col("kind"), visible_text(_json("data", "$.text"))
    picture = (kind == "file") & F.startswith(_json("data", "$.mime"), F.lit("image/"))
    image = picture & image_of(_json("data", "$.url")).isNotNull()
    tool = kind == "tool"
    shown = F.when(kind == "text", "text").when(
        (kind == "reasoning") & thought.isNotNull(), "text"
    ).when(tool, "tool").when(F.coalesce(image, F.lit(False)), "image")
    op, canonical = dialects.parse(
        "opencode", _json("data", "$.tool"), F.coalesce(_json("data", "$.state.input"), F.lit("{}"))
    )
    state = result_status(
        "opencode",
        _json("data", "$.state.status"),
        _json("data", "$.state.error") != "",
        _json("data", "$.state.metadata.interrupted") == "true",
        F.lit(0)
    )
    output = F.coalesce(F.nullif(_json("data", "$.state.output"), F.lit("")), _json("data", "$.state.error"))
    words = F.when(kind == "text", F.coalesce(_json("data", "$.text"), F.lit(""))).when(kind == "reasoning", thought)
    blocks = items.select(
        "session",
        "at",
        F.lit(0).alias("sub"),
        "part",
        "role",
        "source_id",
        "parent_id",
        "created",
        *_block(
            shown,
            words,
            name=F.when(tool, _json("data", "$.tool")),
            op=F.when(tool, op),
            call_id=F.when(tool, _json("data", "$.callID")),
            input=F.when(tool, canonical)
        ),
        F.when(tool, state).alias("status"),
        F.when(tool, output).alias("output")
    ).where("kind is not null")
    rest = items.where(
        ~kind.isin(
            "text", "reasoning", "tool", "step-start", "step-finish", "compaction"
        ) & ~F.coalesce(image, F.lit(False))
    )
    reasoning = items.where("kind = 'reasoning'")
    losses = _loss(rest, "migration.unknown_block_dropped", kind)
    losses = losses.unionByName(
        _loss(reasoning.where(thought.isNotNull()), "migration.reasoning_metadata_dropped", F.lit("metadata"))
    )
    losses = losses.unionByName(
        _loss(reasoning.where(thought.isNull()), "migration.reasoning_dropped", F.lit("metadata"))
    )
    messages, out = _finished(blocks)
    # a summary closes the latest open compaction before it
    cut = items.where("kind = 'compaction'").groupBy("session", "at", "source_id").agg(
        F.min(_json("data", "$.auto")).alias("auto")
    )
    texts = items.where("summary and kind = 'text'").groupBy("session", "at", "source_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("part", _json("data", "$.text").alias("t")))), lambda x: x["t"]
            ),
            "\n"
        ).alias("summary_text")
    )
    said = m.where("summary").join(texts.select("session", "at", "summary_text"), ["session", "at"], "left").select(
        "session", "at", "source_id", F.coalesce("summary_text", F.lit("")).alias("summary_text")
    )
    events = cut.select("session", "at", F.lit(True).alias("opens")).unionByName(
        said.select("session", "at", F.lit(False).alias("opens"))
    )
    order = Window.partitionBy("session").orderBy("at", F.desc("opens"))
    events = events.withColumn(
        "opened_at", F.when(~F.col("opens"), F.lag(F.when(F.col("opens"), F.col("at"))).over(order))
    )
    closed = events.where("opened_at is not null").select("session", F.col("opened_at").alias("ordinal"), "at").join(
        said.withColumnRenamed("source_id", "summary_message_id"), ["session", "at"]
    ).drop("at")
    shown_at = blocks.select("session", "at", "source_id").distinct().join(
        m.where("not coalesce(summary, false)").select("session", "at"), ["session", "at"], "left_semi"
    )
    before = cut.select(
        "session", F.col("at").alias("ordinal")
    ).join(shown_at, "session").where("at < ordinal").groupBy("session", "ordinal").agg(
        F.max_by("source_id", "at").alias("after_message_id")
    )
    trigger = F.when(F.col("auto") == "true", "automatic").when(F.col("auto") == "false", "manual").otherwise("unknown")
    c = cut.withColumnRenamed("at", "ordinal").join(
        closed, ["session", "ordinal"], "left"
    ).join(before, ["session", "ordinal"], "left")
    filled = F.coalesce(F.col("summary_text") != "", F.lit(False))
    c = c.select(
        "session",
        "ordinal",
        F.col("source_id").alias("id"),
        "after_message_id",
        trigger.alias("trigger"),
        F.when(filled, "completed").otherwise("incomplete").alias("state"),
        F.when(filled, "available").otherwise("missing").alias("summary_status"),
        F.when(filled, F.col("summary_text")).alias("summary_text"),
        "summary_message_id",
        F.lit(False).alias("replaces")
    )
    return Tables(messages, out, losses, c)


def chat(rows: DataFrame) -> Tables:
    """Lines of a bundle's chat history (for bundles without updates): users, assistants with their calls, reasoning
    that joins the assistant message before it, results."""
    schema = "type string, role string, id string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"
    r = rows.select(
        F.col("file").alias("session"),
        F.col("line_no").cast("long").alias("at"),
        "raw",
        F.when(_is_object("raw"), F.from_json("raw", schema)).alias("r")
    )
    losses = _loss(r.where("r is null"), "session.malformed_record", F.col("at") + 1)
    w = Window.partitionBy("session").orderBy("at")
    r = r.where("r is not null").withColumn("n", F.row_number().over(w) - 1).select(
        "session", "at", "n", "raw", "r.*"
    ).withColumn("who", F.coalesce("type", "role"))
    own = F.coalesce("id", F.concat(F.lit("chat:"), "n"))
    speaks = F.col("who").isin("user", "assistant")
    last = F.last(
        F.when(speaks, F.struct("at", "who", own.alias("id"))), ignorenulls=True
    ).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("before", last).withColumn("source_id", own)
    none = F.lit(None).cast("string")
    base = lambda part, ordinal: [
        "session",
        "at",
        F.lit(0).alias("sub"),
        part.alias("part"),
        ordinal.alias("ordinal"),
        F.col("who").alias("role"),
        "source_id",
        none.alias("parent_id"),
        none.alias("created")
    ]
    content = F.when(
        _kind_at("raw", "$.content").startswith("ARRAY"), _plain_output(F.col("content"))
    ).otherwise(F.coalesce("content", F.lit("")))
    text = r.where(speaks).select(*base(F.lit(0), F.col("at") * _WIDE), *_block("text", content))
    made = r.where("who = 'assistant'").select(
        "session", "at", "who", "source_id", F.posexplode("tool_calls").alias("k", "c")
    )
    op, canonical = dialects.parse("grok", F.col("c.name"), F.coalesce("c.arguments", F.lit("{}")))
    calls = made.select(
        *base(F.col("k") + 1, F.col("at") * _WIDE + F.col("k") + 1),
        *_block("tool", name=F.coalesce("c.name", F.lit("tool")), op=op, call_id=F.col("c.id"), input=canonical)
    )
    thought = r.where("who = 'reasoning' and before.who = 'assistant' and content <> ''").select(
        "session",
        F.col("before.at").alias("at"),
        F.col("before.who").alias("who"),
        F.col("before.id").alias("source_id"),
        "content",
        F.col("at").alias("_at")
    )
    thought = thought.select(*base(F.col("_at") + _WIDE, -F.col("_at") - 1), *_block("thinking", F.col("content")))
    results = r.where("who = 'tool_result'").select(
        "session",
        F.col("tool_call_id").alias("call_id"),
        (F.col("at") * _WIDE).alias("ordinal"),
        F.lit("success").alias("status"),
        _plain_output(F.col("content")).alias("output")
    )
    paired, _ = _paired(text.unionByName(calls).unionByName(thought), results)
    messages, out = _finished(paired)
    return Tables(messages, out, losses)


def _cuts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(session, lo, hi) of the lines that markers take back, from the users' lines and the markers alone. Sessions come
    whole and in order; `others` counts the lines of any other kind so far."""
    session, state, starts, others = None, None, [], None
    for frame in frames:
        found = []
        for row in frame.itertuples(index=False):
            if row.session != session:
                session, starts, others = row.session, [], None
                state = (False, None, False)  # a prompt was numbered, the last number, within a run without numbers
            if row.others != others:
                state, others = (*state[:2], False), row.others
            indexed, key, run = state
            if not row.marker:
                if pd.notna(row.prompt):
                    if key != row.prompt:
                        starts.append((row.at, state))
                    state = (True, row.prompt, False)
                elif not indexed and not run:
                    starts.append((row.at, state))
                    state = (indexed, None, True)
            elif pd.notna(row.target) and 0 <= row.target < len(starts):
                lo, state = starts[int(row.target)]
                del starts[int(row.target) :]
                found.append((session, lo, row.at))
            elif pd.notna(row.target) and row.target == len(starts):
                found.append((session, row.at, row.at))
            else:
                state = (indexed, key, False)
        if found:
            yield pd.DataFrame(found, columns=["session", "lo", "hi"])


def without_rewound(rows: DataFrame) -> DataFrame:
    """Update lines (file, line_no, raw) that are still visible after rewind markers. A marker that names an unknown
    prompt stays as a record. Only the users' lines and the markers of sessions with markers are walked in order, for
    the ranges that are taken back; lines are then held against the farthest end of the ranges before them."""
    u = lambda path, kind: F.try_variant_get(F.try_parse_json("raw"), path, kind)
    update = u("$.params.update.sessionUpdate", "string")
    user = (u("$.method", "string") == "session/update") & (update == "user_message_chunk") & ~F.coalesce(
        u("$.params.update._meta.hostTurn", "boolean"), F.lit(False)
    )
    marker = (u("$.method", "string") == "_x.ai/session/update") & (update == "rewind_marker")
    no = F.lit(False)
    whole = lambda path: F.when(u(path, "double") == F.floor(u(path, "double")), u(path, "double"))
    lines = rows.select(F.col("file").alias("session"), F.col("line_no").cast("long").alias("at"), "raw")
    kinds = lines.select(
        "session",
        "at",
        F.coalesce(user, no).alias("user"),
        F.coalesce(marker, no).alias("marker"),
        whole("$.params.update._meta.promptIndex").alias("prompt"),
        whole("$.params.update.target_prompt_index").alias("target")
    )
    marked = kinds.where("marker").select("session").distinct()
    so_far = Window.partitionBy("session").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = F.when(F.col("user") | F.col("marker"), 0).otherwise(1)
    steps = kinds.join(marked, "session", "left_semi").withColumn(
        "others", F.sum(other).over(so_far)
    ).where("user or marker")
    ranges = steps.repartition("session").sortWithinPartitions("session", "at").mapInPandas(
        _cuts, "session string, lo long, hi long"
    )
    held = lines.withColumn("hi", F.lit(None).cast("long")).withColumn("line", F.lit(1))
    ends = ranges.select(
        "session", F.col("lo").alias("at"), F.lit(None).cast("string").alias("raw"), "hi", F.lit(0).alias("line")
    )
    order = Window.partitionBy("session").orderBy("at", "line").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return held.unionByName(ends).withColumn("until", F.max("hi").over(order)).where(
        "line = 1 and (until is null or until < at)"
    ).select("session", "at", "raw")
