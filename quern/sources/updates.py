"""Streamed updates of a session (lines of envelopes) to canonical tables.

An update belongs to a prompt: by its id, by the one id that its index stands for, or, for a tool, by the one prompt
that any of its updates names. Chunks of text and thinking that follow each other are one block, a call stands where its
first update was, and what its later updates say is folded by call. Everything is keyed by session, prompt and call, so
no session has to pass through one task whole; only prompts without any name are numbered in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import unwrapped
from ..operators import dialects
from ..operators.topology import _durable
from .canonical import Tables, _finished, _loss, _metrics, chat, without_rewound

#: How formats name the kinds of updates, the states that end a call, and states as results have them.
USER = (("UserMessage", "Prompt"), ("user_message_chunk",), ("user_message", "prompt"))
SAID = {"text": ("AgentMessageChunk", "agent_message_chunk"), "thinking": ("AgentThoughtChunk", "agent_thought_chunk")}
TOOL = (("ToolCall", "ToolCallUpdate"), ("tool_call", "tool_call_update"))
TERMINAL = ("completed", "failed")
STATES = {"completed": "success", "failed": "error", "pending": "pending"}
UNASSIGNED = "prompt:unassigned"
#: Lists within lists of contents that are read.
NESTED = 3


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _filled(c: Column) -> Column:
    """A variant as text, null where it is empty, false, null or no scalar."""
    kind = F.schema_of_variant(c)
    text = F.when(
        kind.isin("STRING", "BIGINT", "BOOLEAN", "DOUBLE") | kind.startswith("DECIMAL"),
        F.try_variant_get(c, "$", "string")
    )
    return F.when(~text.isin("", "0", "false"), text)


def content_text(v: Column, depth: int = NESTED) -> Column:
    """The text of a content: a string, an object's text, or those of a list's items one after the other."""
    kind = F.schema_of_variant(v)
    out = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(
        F.startswith(kind, F.lit("OBJECT<")), _filled(_get(v, "$.text"))
    )
    if depth:
        items = F.try_variant_get(v, "$", "array<variant>")
        out = out.when(
            F.startswith(kind, F.lit("ARRAY")),
            F.array_join(F.transform(items, lambda x: content_text(x, depth - 1)), "")
        )
    return F.coalesce(out, F.lit(""))


def _numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(session, at, prompt) of updates that name no prompt: each gets the number of prompts before it as its name."""
    session, seen = None, set()
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if row.session != session:
                session, seen = row.session, set()
            prompt = row.prompt
            if prompt is None:
                prompt = f"prompt:{len(seen)}"
                out.append((row.session, row.at, prompt))
            seen.add(prompt)
        if out:
            yield pd.DataFrame(out, columns=["session", "at", "prompt"])


def _events(lines: DataFrame) -> DataFrame:
    """One row per visible update (session, at, raw): what it says, and the prompt, index and call that it names."""
    v = F.try_parse_json("raw")
    e = lines.select("session", "at", _get(v, "$.params.update").alias("u"), _get(v, "$.params._meta").alias("m"))
    u, m = F.col("u"), F.col("m")
    nested, params = _get(u, "$._meta"), _get(m, "$.updateParams")
    told = F.when(
        _get(m, "$.promptIndex").isNotNull(), _get(m, "$.promptIndex")
    ).otherwise(_get(nested, "$.promptIndex"))
    index = F.when(~F.is_variant_null(told), F.try_variant_get(told, "$", "string"))
    of = F.coalesce(_filled(_get(m, "$.promptId")), _filled(_get(u, "$.prompt_id")))
    call = F.coalesce(
        _filled(_get(params, "$.toolCallId")),
        _filled(_get(u, "$.toolCallId")),
        _filled(_get(m, "$.toolCallId")),
        F.lit("")
    )
    name = F.coalesce(
        _filled(_get(nested, "$['x.ai/tool'].name")),
        _filled(_get(u, "$.title")),
        _filled(_get(params, "$.kind")),
        _filled(_get(u, "$.kind")),
        F.lit("tool")
    )
    kinds = [_get(m, "$.updateType", "string"), _get(u, "$.sessionUpdate", "string"), _get(u, "$.kind", "string")]
    one = lambda names: F.coalesce(
        kinds[0].isin(*names[0]), F.lit(False)
    ) | F.coalesce(kinds[1].isin(*names[1]), F.lit(False))
    said = lambda name: F.coalesce(
        kinds[0] == SAID[name][0], F.lit(False)
    ) | F.coalesce(kinds[1] == SAID[name][1], F.lit(False))
    user = one(USER) | F.coalesce(kinds[2].isin(*USER[2]), F.lit(False))
    shrinks = F.coalesce(kinds[2] == "compaction", F.lit(False)) | F.coalesce(kinds[0] == "Compaction", F.lit(False))
    tool = one(TOOL)
    what = F.when(user, "user").when(said("text"), "text").when(said("thinking"), "thinking")
    what = what.when(
        tool, F.when(call != "", "tool").otherwise("unknown")
    ).when(shrinks, "compaction").otherwise("unknown")
    given = lambda path: F.when(~F.is_variant_null(_get(u, path)), F.to_json(_get(u, path)))
    return e.select(
        "session", "at", of.alias("named"), index.alias("index"), tool.alias("is_tool"), F.when(tool, call).otherwise("").alias("call_id"), what.alias("what"),
        content_text(
            _get(u, "$.content")
        ).alias("text"), name.alias("name"), given("$.rawInput").alias("raw_input"), given(
            "$.rawOutput"
        ).alias("raw_output"),
        F.lower(_filled(_get(params, "$.status"))).alias("status"), F.when(shrinks, F.to_json(u)).alias("event"),
    )


def _owned(events: DataFrame) -> DataFrame:
    """Adds `prompt`: the one that an update belongs to. Updates of a tool that no prompt, or more than one, owns belong
    to UNASSIGNED and are `unknown`."""
    by_index = events.where("named is not null and index is not null").groupBy("session", "index").agg(
        F.min("named").alias("_a"), F.max("named").alias("_b")
    )
    e = events.join(by_index, ["session", "index"], "left")
    alone = F.when(F.col("_a") == F.col("_b"), F.col("_a"))
    key = F.coalesce("named", alone, F.concat(F.lit("prompt:"), "index"))
    e = e.withColumn("key", key).drop("_a", "_b")
    owners = e.where("is_tool and call_id <> '' and key is not null").groupBy("session", "call_id").agg(
        F.min("key").alias("_a"), F.max("key").alias("_b")
    )
    e = e.join(owners, ["session", "call_id"], "left")
    split = F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))
    key = F.when(F.col("is_tool"), F.when(~split, F.coalesce("key", "_a"))).otherwise(F.col("key"))
    lost = F.col("is_tool") & key.isNull()
    e = e.select(*events.columns, F.when(lost, UNASSIGNED).otherwise(key).alias("prompt"), lost.alias("lost"))
    e = _durable(e.withColumn("what", F.when(F.col("lost"), "unknown").otherwise(F.col("what"))).drop("lost", "named"))
    nameless = e.where("prompt is null").select("session").distinct()
    firsts = e.where("prompt is not null").groupBy("session", "prompt").agg(F.min("at").alias("at")).join(
        nameless, "session", "left_semi"
    )
    steps = firsts.select("session", "at", "prompt").unionByName(
        e.where("prompt is null").select("session", "at", "prompt")
    )
    numbers = steps.repartition("session").sortWithinPartitions("session", "at").mapInPandas(
        _numbered, "session string, at long, prompt string"
    )
    numbers = numbers.withColumnRenamed("prompt", "_number")
    return e.join(numbers, ["session", "at"], "left").withColumn(
        "prompt", F.coalesce("prompt", "_number")
    ).drop("_number")


def _calls(e: DataFrame) -> DataFrame:
    """Each call once: its first name that says more than `tool`, last input, last output and its state, which stays
    once it is terminal."""
    out = F.coalesce(
        F.when(F.col("text") != "", F.to_json(F.struct(F.col("text").alias("t")))),
        F.concat(F.lit('{"o":'), "raw_output", F.lit("}"))
    )
    t = e.where("what = 'tool'").withColumn("out", out).withColumn("ends", F.col("status").isin(*TERMINAL))
    has = lambda c, test: F.max_by(c, F.when(test, F.col("at")))
    t = t.groupBy("session", "prompt", "call_id").agg(
        F.min("at").alias("at"),
        F.min_by("name", F.when(F.col("name") != "tool", F.col("at"))).alias("name"),
        has("raw_input", F.col("raw_input").isNotNull()).alias("raw_input"),
        has("out", F.col("out").isNotNull()).alias("out"),
        has("status", F.col("ends")).alias("ended"),
        has("status", F.col("status").isNotNull()).alias("status"),
    )
    text, raw = F.get_json_object("out", "$.t"), F.to_json(_get(F.try_parse_json("out"), "$.o"))
    is_text = F.schema_of_variant(F.try_parse_json(raw)) == "STRING"
    opened = unwrapped(raw)
    shown = F.coalesce(
        text, opened["text"], F.when(is_text, F.try_variant_get(F.try_parse_json(raw), "$", "string")), raw
    )
    state = F.coalesce("ended", "status", F.lit("unknown"))
    mapped = F.coalesce(
        F.try_element_at(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv)), state), F.lit("unknown")
    )
    failed = (mapped == "success") & (F.coalesce(F.when(text.isNull(), opened["exit_code"]), F.lit(0)) != 0)
    held = F.try_parse_json(F.coalesce("raw_input", F.lit("{}")))
    packed = F.when(F.schema_of_variant(held) == "STRING", F.try_variant_get(held, "$", "string"))
    given = F.when(F.try_parse_json(packed).isNotNull(), packed).otherwise(F.coalesce("raw_input", F.lit("{}")))
    name = F.coalesce("name", F.lit("tool"))
    op, canonical = dialects.parse("grok", name, given)
    done = F.col("out").isNotNull()
    return t.select(
        "session",
        "prompt",
        "at",
        "call_id",
        name.alias("name"),
        op.alias("op"),
        canonical.alias("input"),
        F.when(done, F.when(failed, "error").otherwise(mapped)).alias("status"),
        F.when(done, shown).alias("output")
    )


def updates(rows: DataFrame) -> Tables:
    """Lines of updates (file, line_no, raw). What rewind markers take back is left out first. A line that is no object
    is a loss (a torn last line is none); a prompt's updates of unknown kinds are one loss with their count."""
    lines = rows.select(
        F.col("file").alias("session"), F.col("line_no").cast("long").alias("at"), "raw"
    ).where("trim(coalesce(raw, '')) <> ''")
    parsed = F.try_parse_json("raw")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT<")), F.lit(False))
    last = lines.groupBy("session").agg(F.max("at").alias("last"))
    bad = lines.where(~is_object).withColumn(
        "torn", parsed.isNull()
    ).join(last, "session").where("not torn or at < last")
    losses = _loss(bad, "session.malformed_record", F.col("at") + 1)
    good = lines.where(is_object).select(F.col("session").alias("file"), F.col("at").alias("line_no"), "raw")
    e = _durable(_owned(_events(without_rewound(good))))
    prompts = e.groupBy("session", "prompt").agg(
        F.min("at").alias("prompt_at"),
        F.max((F.col("what") == "user").cast("int")).alias("asked"),
        F.count(F.when(F.col("what") == "unknown", 1)).alias("unknown")
    )
    losses = losses.unionByName(
        _loss(
            prompts.where("unknown > 0"),
            "migration.unknown_block_dropped",
            F.concat(F.lit("session_update "), "unknown")
        )
    )
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c]), "")
    asked = e.where("what = 'user'").groupBy("session", "prompt").agg(in_order("text").alias("text"))
    calls = _durable(_calls(e))
    # chunks of one kind that no other block comes between are one
    spoken = e.where("what in ('text', 'thinking')").select(
        "session", "prompt", "at", F.col("what").alias("kind"), "text"
    )
    marks = spoken.unionByName(
        calls.select("session", "prompt", "at", F.lit("tool").alias("kind"), F.lit("").alias("text"))
    )
    w = Window.partitionBy("session", "prompt").orderBy("at")
    change = F.when(F.lag("kind").over(w).eqNullSafe(F.col("kind")) & (F.col("kind") != "tool"), 0).otherwise(1)
    marks = marks.withColumn("_change", change).withColumn(
        "island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    chunks = marks.where("kind <> 'tool'").groupBy("session", "prompt", "island").agg(
        F.min("kind").alias("kind"), F.min("at").alias("at"), in_order("text").alias("text")
    ).where("text <> ''")
    none = F.lit(None).cast("string")
    fields = ("name", "op", "call_id", "input", "status", "output")
    empty = [none.alias(c) for c in fields]
    who = lambda role: [F.lit(role).alias("role"), F.concat("prompt", F.lit(f":{role}")).alias("source_id")]
    blocks = asked.select(
        "session",
        "prompt",
        F.lit(0).alias("sub"),
        F.lit(0).cast("long").alias("part"),
        *who("user"),
        F.lit("text").alias("kind"),
        "text",
        *empty
    )
    blocks = blocks.unionByName(
        chunks.select(
            "session",
            "prompt",
            F.lit(1).alias("sub"),
            F.col("at").alias("part"),
            *who("assistant"),
            "kind",
            "text",
            *empty
        )
    )
    blocks = blocks.unionByName(
        calls.select(
            "session",
            "prompt",
            F.lit(1).alias("sub"),
            F.col("at").alias("part"),
            *who("assistant"),
            F.lit("tool").alias("kind"),
            none.alias("text"),
            *fields
        )
    )
    blocks = blocks.join(prompts.select("session", "prompt", F.col("prompt_at").alias("at")), ["session", "prompt"])
    blocks = blocks.withColumn("parent_id", none).withColumn("created", none)
    messages, out = _finished(blocks)
    return Tables(messages, out, losses, _compactions(e, blocks, prompts))


def _compactions(e: DataFrame, blocks: DataFrame, prompts: DataFrame) -> DataFrame:
    """The last compaction of each prompt, behind the prompt's own last message or that of an earlier prompt."""
    c = e.where("what = 'compaction'").groupBy("session", "prompt").agg(
        F.max_by("event", "at").alias("event"), F.max("at").alias("ordinal")
    )
    c = c.join(prompts.select("session", "prompt", F.col("prompt_at").alias("at")), ["session", "prompt"])
    said = blocks.groupBy("session", "at", "sub").agg(F.min("source_id").alias("source_id")).select(
        "session",
        "at",
        "sub",
        "source_id",
        none_of("prompt"),
        none_of("event"),
        F.lit(None).cast("long").alias("ordinal")
    )
    both = said.unionByName(
        c.select("session", "at", F.lit(2).alias("sub"), none_of("source_id"), "prompt", "event", "ordinal")
    )
    before = Window.partitionBy("session").orderBy("at", "sub").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("after", F.last("source_id", ignorenulls=True).over(before)).where("event is not null")
    v = F.try_parse_json("event")
    text = _filled(_get(v, "$.summary"))
    name = F.coalesce(_filled(_get(v, "$.id")), F.concat("prompt", F.lit(":compaction")))
    status = F.when(text.isNotNull(), "available").otherwise("missing")
    return both.select(
        "session",
        "ordinal",
        name.alias("id"),
        F.col("after").alias("after_message_id"),
        F.lit("unknown").alias("trigger"),
        F.lit("completed").alias("state"),
        status.alias("summary_status"),
        text.alias("summary_text"),
        F.lit(None).cast("string").alias("summary_message_id"),
        F.lit(False).alias("replaces"),
        _metrics({"tokens_before": _get(v, "$.tokensBefore", "bigint")})
    )


def none_of(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def bundles(update_lines: DataFrame, chat_lines: DataFrame) -> Tables:
    """Sessions by their updates, and those without a readable update by their chat history."""
    is_object = F.startswith(F.schema_of_variant(F.try_parse_json("raw")), F.lit("OBJECT<"))
    streamed = update_lines.where(is_object).select("file").distinct()
    a, b = updates(update_lines), chat(chat_lines.join(streamed, "file", "left_anti"))
    return Tables(
        a.messages.unionByName(b.messages),
        a.blocks.unionByName(b.blocks),
        a.losses.unionByName(b.losses),
        a.compactions
    )
