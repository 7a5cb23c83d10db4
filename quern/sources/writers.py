"""Writers of canonical blocks (see `canonical`) as native records of five formats.

Ids are digests of session and place, times count up from `start_ms` in steps of two seconds, so a rerun writes the
same records. A call that a format has no tool for, or whose input is not valid, is told as text. Every native call
gets a result, an empty one where none is known. Images and the thinking of formats without it are left out. Blocks
of a message meet in one row, never those of a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import narrated, shell_word
from ..operators import dialects
from ..operators.tools import valid_input
from ..operators.turns import strictly_increasing

STEP_MS = 2000


def claude_lines(messages: DataFrame) -> DataFrame:
    """(session_id, message_idx, line): a chain of records by deterministic ids, times strictly increasing.
    Needs session_id, message_idx, role, text, created_ms, dir."""
    uid = lambda idx: F.sha2(F.concat_ws("/", "session_id", idx.cast("string")), 256).substr(1, 32)
    m = strictly_increasing(messages, "session_id", "message_idx", "created_ms")
    m = m.withColumn("uuid", uid(F.col("message_idx"))).withColumn(
        "parentUuid", F.lag("uuid").over(Window.partitionBy("session_id").orderBy("message_idx"))
    )
    stamp = F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    body = F.struct(
        "parentUuid",
        F.lit(False).alias("isSidechain"),
        F.col("role").alias("type"),
        "uuid",
        F.col("dir").alias("cwd"),
        F.col("session_id").alias("sessionId"),
        stamp.alias("timestamp"),
        F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message")
    )
    return m.select("session_id", "message_idx", F.to_json(body).alias("line"))


def write_sessions(rows: DataFrame, path: str) -> None:
    """One folder per session; within it the lines are in message order."""
    rows.repartition("session_id").sortWithinPartitions("session_id", "message_idx").select(
        "session_id", F.col("line").alias("value")
    ).write.partitionBy("session_id").text(path)


def _q(value: str | Column) -> Column:
    """A string as JSON; null stays null."""
    value = F.lit(value) if isinstance(value, str) else value
    one = F.to_json(F.array(value.cast("string")))
    return F.when(value.isNotNull(), F.substring(one, F.lit(2), F.length(one) - 2))


def _object(**fields: Column) -> Column:
    """A JSON object of fields that are JSON themselves; null ones are left out."""
    return F.concat(
        F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items())), F.lit("}")
    )


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def _id(prefix: str, *parts: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 24))


def _stamp(ms: Column) -> Column:
    return _q(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def _told(blocks: DataFrame) -> DataFrame:
    """Calls without a native name as text."""
    lost = (F.col("kind") == "tool") & F.col("native").isNull()
    told = narrated(F.coalesce("name", F.lit("tool")), F.coalesce("input", F.lit("{}")), F.col("output"))
    return blocks.withColumn("degraded", F.coalesce(lost, F.lit(False))).withColumn(
        "text", F.when(lost, told).otherwise(F.col("text"))
    ).withColumn(
        "kind", F.when(lost, "text").otherwise(F.col("kind"))
    )


def native_calls(blocks: DataFrame, tool: str, where: Column | None = None) -> DataFrame:
    """Texts and calls with `native` (tool name), `given` (its input as JSON), `call` (a new id) and `degraded`. Calls
    outside of `where` are told as text."""
    blocks = blocks.where(F.col("kind").isin("text", "thinking", "tool"))
    name, given = dialects.render(tool, F.col("op"), F.col("input"))
    fits = (F.col("kind") == "tool") & (valid_input("op", "input") | (F.col("op") == "tool.invoke"))
    fits = fits if where is None else fits & where
    out = blocks.withColumn("native", F.when(fits, name)).withColumn("given", F.when(fits, given))
    return _told(out.withColumn("call", _id("call_", "session", "message_idx", "block_idx")))


def degraded(blocks: DataFrame, tool: str) -> DataFrame:
    """The losses of writing: (session, code, detail) of every call that is told as text."""
    return native_calls(blocks, tool).where("degraded").select(
        "session", F.lit("migration.tool_degraded").alias("code"), F.col("name").alias("detail")
    )


def _runs(blocks: DataFrame) -> DataFrame:
    """(session, message_idx, run, role, sub, text, calls...): texts between two native calls of a message are one row
    (sub 0); a call is two, one for itself (1) and one for its result (2)."""
    w = Window.partitionBy("session", "message_idx").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    call = F.col("native").isNotNull()
    b = blocks.withColumn(
        "run", F.coalesce(F.count(F.when(call, 1)).over(w), F.lit(0))
    ).withColumn("sub", F.when(call, 1).otherwise(0))
    texts = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("block_idx", "text"))))
    fields = [F.first(c).alias(c) for c in ("native", "given", "call", "op", "status", "output")]
    g = b.groupBy("session", "message_idx", "run", "role", "sub").agg(
        F.transform(texts, lambda x: x["text"]).alias("texts"), *fields
    )
    g = g.where(
        (F.col("sub") == 1) | (F.size("texts") > 0)
    ).withColumn("text", F.array_join("texts", "\n\n")).drop("texts")
    return g.withColumn(
        "sub", F.explode(F.when(F.col("sub") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0))))
    )


def _placed(rows: DataFrame, order: list[str], start_ms: int) -> DataFrame:
    """Rows with their place in the session (from 1), an id, the id before it and a time."""
    w = Window.partitionBy("session").orderBy(*order)
    out = rows.withColumn("place", F.row_number().over(w).cast("long")).withColumn("id", _id("", "session", "place"))
    return out.withColumn("before", F.lag("id").over(w)).withColumn("ms", F.lit(start_ms) + F.col("place") * STEP_MS)


def claude_records(blocks: DataFrame, start_ms: int, cwd: str) -> DataFrame:
    """(session, line_no, raw): a text is a record, a call is one with its result in a record after it."""
    mine = (F.col("sub") == 1) | (F.col("sub") == 0) & (F.col("role") == "assistant")
    runs = _runs(native_calls(blocks, "claude")).withColumn("role", F.when(mine, "assistant").otherwise("user"))
    r = _placed(runs, ["message_idx", "run", "sub"], start_ms)
    text = _object(type=_q("text"), text=_q(F.col("text")))
    use = _object(type=_q("tool_use"), id=_q(F.col("call")), name=_q(F.col("native")), input=F.col("given"))
    answer = _object(
        type=_q("tool_result"),
        tool_use_id=_q(F.col("call")),
        content=_q(F.coalesce("output", F.lit(""))),
        is_error=F.when(F.col("status") == "error", "true")
    )
    sub = F.col("sub")
    content = F.when(sub == 1, _list(use)).when(sub == 2, _list(answer)).when(
        F.col("role") == "user", _q(F.col("text"))
    ).otherwise(_list(text))
    message = _object(role=_q(F.col("role")), content=content)
    raw = _object(
        type=_q(F.col("role")),
        uuid=_q(F.col("id")),
        parentUuid=F.coalesce(_q(F.col("before")), F.lit("null")),
        sessionId=_q(F.col("session")),
        cwd=_q(cwd),
        isSidechain=F.lit("false"),
        timestamp=_stamp(F.col("ms")),
        message=message
    )
    return r.select("session", F.col("place").alias("line_no"), raw.alias("raw"))


def _shell(op: Column, v: Column) -> Column:
    """The command line that stands for a call where a format only has a shell; null for other operations."""
    get = lambda name: F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
    where = shell_word(F.coalesce(get("path"), F.lit(".")))
    glob = F.when(get("glob").isNotNull(), F.concat(F.lit("-g "), shell_word(get("glob"))))
    search = F.concat_ws(
        " ", F.lit("rg --line-number --color never"), glob, F.lit("--"), shell_word(get("query")), where
    )
    files = F.concat_ws(" ", F.lit("rg --files -g"), shell_word(get("pattern")), F.lit("--"), where)
    out = F.when(op == "shell.exec", get("command")).when(
        op == "fs.read", F.concat(F.lit("cat "), shell_word(get("file_path")))
    )
    return out.when(
        (op == "fs.search") & get("query").isNotNull(), search
    ).when((op == "fs.glob") & get("pattern").isNotNull(), files)


def _patch(op: Column, v: Column) -> Column:
    """The patch text that stands for a write or an edit; null for other operations."""
    get = lambda name: F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
    lines = lambda name: F.split(F.regexp_replace(F.coalesce(get(name), F.lit("")), "\r?\n$", ""), "\r?\n")

    def marked(mark: str, name: str) -> Column:
        return F.when(
            get(name).isNotNull(), F.array_join(F.transform(lines(name), lambda x: F.concat(F.lit(mark), x)), "\n")
        )

    def patch(verb: str, *body: Column) -> Column:
        return F.concat_ws(
            "\n",
            F.lit("*** Begin Patch"),
            F.concat(F.lit(f"*** {verb} File: "), get("file_path")),
            *body,
            F.lit("*** End Patch")
        )

    named = get("file_path").isNotNull()
    out = F.when((op == "fs.write") & named, patch("Add", marked("+", "content")))
    return out.when(
        (op == "fs.edit") & named, patch("Update", F.lit("@@"), marked("-", "old"), marked("+", "new"))
    ).when(op == "fs.patch", get("raw_patch"))


def codex_calls(blocks: DataFrame) -> DataFrame:
    """As `native_calls`: reads, searches and globs are shell commands, writes and edits are patches."""
    v, op = F.try_parse_json("input"), F.when(F.col("kind") == "tool", F.col("op"))
    shell, patch = _shell(op, v), _patch(op, v)
    workdir = F.try_variant_get(v, "$.workdir", "string")
    given = F.when(shell.isNotNull(), _object(command=_q(shell), workdir=_q(workdir))).otherwise(patch)
    name = F.when(shell.isNotNull(), "shell").when(patch.isNotNull(), "apply_patch")
    return _told(
        blocks.withColumn("native", name).withColumn("given", given).withColumn(
            "call", _id("call_", "session", "message_idx", "block_idx")
        )
    )


def codex_records(blocks: DataFrame, start_ms: int, cwd: str) -> DataFrame:
    """(session, line_no, raw): a header, then messages, calls and their outputs. A role that the format does not know
    is written before the user's text."""
    b = codex_calls(blocks)
    foreign = ~F.col("role").isin("user", "assistant") & (F.col("kind") == "text")
    b = b.withColumn(
        "text", F.when(foreign, F.concat(F.lit("["), "role", F.lit("]\n"), "text")).otherwise(F.col("text"))
    )
    runs = _runs(b.withColumn("role", F.when(F.col("role") == "assistant", "assistant").otherwise("user")))
    head = blocks.select("session").distinct().select(
        "session", F.lit(0).cast("long").alias("message_idx"), F.lit(-1).alias("sub")
    )
    r = _placed(runs.unionByName(head, allowMissingColumns=True), ["message_idx", "run", "sub"], start_ms)
    sub, patched = F.col("sub"), F.col("native") == "apply_patch"
    kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text")
    said = _object(
        type=_q("message"), role=_q(F.col("role")), content=_list(_object(type=_q(kind), text=_q(F.col("text"))))
    )
    plain = _object(
        type=_q("function_call"), name=_q(F.col("native")), call_id=_q(F.col("call")), arguments=_q(F.col("given"))
    )
    custom = _object(
        type=_q("custom_tool_call"), name=_q(F.col("native")), call_id=_q(F.col("call")), input=_q(F.col("given"))
    )
    result = _object(
        status=_q(F.coalesce("status", F.lit("success"))),
        output=_q(F.coalesce("output", F.lit(""))),
        metadata=_object(exit_code=F.when(F.col("status") == "error", "1").otherwise("0"))
    )
    answer = _object(
        type=_q(F.when(patched, "custom_tool_call_output").otherwise("function_call_output")),
        call_id=_q(F.col("call")),
        output=_q(result)
    )
    meta = _object(id=_q(F.col("session")), cwd=_q(cwd), timestamp=_stamp(F.col("ms")))
    payload = F.when(sub == -1, meta).when(sub == 0, said).when(sub == 2, answer).when(patched, custom).otherwise(plain)
    kind_of = F.when(sub == -1, "session_meta").otherwise("response_item")
    raw = _object(timestamp=_stamp(F.col("ms")), type=_q(kind_of), payload=payload)
    return r.select("session", F.col("place").alias("line_no"), raw.alias("raw"))


def pi_records(blocks: DataFrame, start_ms: int, cwd: str) -> DataFrame:
    """(session, line_no, raw): a header, a message record for each message, a record for each result after it."""
    b = native_calls(blocks, "pi")
    b = b.withColumn(
        "nth", F.row_number().over(Window.partitionBy("session", "message_idx").orderBy("block_idx")).cast("long")
    )
    kind = F.col("kind")
    text = F.when(kind == "text", _object(type=_q("text"), text=_q(F.coalesce("text", F.lit("")))))
    thought = F.when(
        (kind == "thinking") & (F.col("role") == "assistant"),
        _object(type=_q("thinking"), thinking=_q(F.coalesce("text", F.lit(""))))
    )
    call = F.when(
        F.col("native").isNotNull(),
        _object(type=_q("toolCall"), id=_q(F.col("call")), name=_q(F.col("native")), arguments=F.col("given"))
    )
    part = F.coalesce(text, thought, call)
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("nth", part.alias("part")))))
    results = F.array_sort(
        F.collect_list(F.when(F.col("native").isNotNull(), F.struct("nth", "native", "call", "status", "output")))
    )
    g = b.groupBy("session", "message_idx", "role").agg(
        F.array_join(F.transform(parts, lambda x: x["part"]), ",").alias("joined"), results.alias("results")
    )
    # the message itself, then its results
    g = g.withColumn(
        "x", F.explode(F.concat(F.array(F.lit(None).cast(g.schema["results"].dataType.elementType)), "results"))
    )
    role = F.when(F.col("x").isNull(), F.col("role")).otherwise("toolResult").alias("role")
    g = g.select(
        "session",
        "message_idx",
        role,
        F.coalesce("x.nth", F.lit(-1)).alias("sub"),
        "joined",
        "x.native",
        "x.call",
        "x.status",
        "x.output"
    )
    head = blocks.select("session").distinct().select(
        "session", F.lit(0).cast("long").alias("message_idx"), F.lit(-2).cast("long").alias("sub")
    )
    r = _placed(g.unionByName(head, allowMissingColumns=True), ["message_idx", "sub"], start_ms)
    answer = _list(_object(type=_q("text"), text=_q(F.coalesce("output", F.lit("")))))
    content = F.when(F.col("call").isNull(), F.concat(F.lit("["), "joined", F.lit("]"))).otherwise(answer)
    failed = F.when(F.col("call").isNotNull(), F.when(F.col("status") == "error", "true").otherwise("false"))
    message = _object(
        role=_q(F.col("role")),
        toolCallId=_q(F.col("call")),
        toolName=_q(F.col("native")),
        content=content,
        isError=failed,
        timestamp=F.col("ms").cast("string")
    )
    parent = F.when(F.col("place") > 2, _q(F.col("before"))).otherwise("null")
    entry = _object(
        type=_q("message"), id=_q(F.col("id")), parentId=parent, timestamp=_stamp(F.col("ms")), message=message
    )
    header = _object(
        type=_q("session"), version=F.lit("3"), id=_q(F.col("session")), timestamp=_stamp(F.col("ms")), cwd=_q(cwd)
    )
    return r.select(
        "session", F.col("place").alias("line_no"), F.when(F.col("sub") == -2, header).otherwise(entry).alias("raw")
    )


def database_records(blocks: DataFrame, start_ms: int) -> tuple[DataFrame, DataFrame]:
    """(messages, parts) with JSON data; ids sort as the rows do, an assistant's parent is the user before it."""
    b = native_calls(blocks.where(F.col("kind").isin("text", "tool")), "opencode")
    ordered = lambda prefix, *parts: F.concat(
        F.lit(prefix),
        F.substring(F.sha2("session", 256), 1, 12),
        *(F.lpad(F.col(p).cast("string"), 10, "0") for p in parts)
    )
    m = b.select("session", "message_idx", "role").distinct().withColumn(
        "id", ordered("msg_", "message_idx")
    ).withColumn(
        "ms", F.lit(start_ms) + F.col("message_idx") * STEP_MS
    )
    earlier = Window.partitionBy("session").orderBy("message_idx").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("id")), ignorenulls=True).over(earlier)
    m = m.withColumn("asked", asked)
    data = _object(
        role=_q(F.col("role")),
        parentID=F.when(F.col("role") == "assistant", _q(F.col("asked"))),
        time=_object(created=F.col("ms").cast("string"))
    )
    messages = m.select(
        "id", F.col("session").alias("session_id"), data.alias("data"), F.col("ms").alias("time_created")
    )
    ms, output = F.lit(start_ms) + F.col("message_idx") * STEP_MS, F.coalesce("output", F.lit(""))
    state = F.when(F.col("status").isin("error", "running", "pending"), F.col("status")).otherwise("completed")
    failed = F.col("status") == "error"
    told = F.when(failed, _q(F.coalesce(F.nullif(output, F.lit("")), F.lit("Tool failed"))))
    result = _object(
        status=_q(state),
        input=F.col("given"),
        output=F.when(~F.coalesce(failed, F.lit(False)), _q(output)),
        error=told,
        time=_object(start=ms.cast("string"), end=ms.cast("string"))
    )
    call = _object(type=_q("tool"), tool=_q(F.col("native")), callID=_q(F.col("call")), state=result)
    text = _object(type=_q("text"), text=_q(F.coalesce("text", F.lit(""))))
    parts = b.select(
        ordered("prt_", "message_idx", "block_idx").alias("id"),
        ordered("msg_", "message_idx").alias("message_id"),
        F.col("session").alias("session_id"),
        F.when(F.col("native").isNull(), text).otherwise(call).alias("data"),
        ms.alias("time_created")
    )
    return messages, parts


def bundle_records(blocks: DataFrame) -> DataFrame:
    """(session, file, line_no, raw): the chat history and the updates of a bundle. A user's calls are told as text;
    an assistant's texts are one, its results follow it. Prompts are counted by user messages."""
    b = native_calls(blocks.where(F.col("kind").isin("text", "tool")), "grok", F.col("role") == "assistant")
    # numbered by a window, so that filters on what was rendered stay above it
    b = b.withColumn(
        "nth", F.row_number().over(Window.partitionBy("session", "message_idx").orderBy("block_idx")).cast("long")
    )
    keys, mine, call = ["session", "message_idx", "role"], F.col("role") == "assistant", F.col("native").isNotNull()
    text = _q(F.coalesce("text", F.lit("")))
    use = _object(id=_q(F.col("call")), name=_q(F.col("native")), arguments=_q(F.col("given")))
    ordered = lambda value, sep: F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("nth", value.alias("v"))))), lambda x: x["v"]
        ),
        sep
    )
    parts = F.when(~mine, _object(type=_q("text"), text=text))
    words = F.when(~call, F.coalesce("text", F.lit("")))
    spoken = b.groupBy(*keys).agg(
        ordered(parts, ",").alias("parts"),
        ordered(words, "").alias("words"),
        F.nullif(ordered(F.when(call, use), ","), F.lit("")).alias("calls")
    )
    spoken = spoken.withColumn("sub", F.lit(-1).cast("long"))
    results = b.where(call).select(
        "session", "message_idx", F.lit("tool_result").alias("role"), F.col("nth").alias("sub"), "call", "output"
    )
    chat = _placed(spoken.unionByName(results, allowMissingColumns=True), ["message_idx", "sub"], 0)
    role = F.when(F.col("role").isin("assistant", "tool_result"), F.col("role")).otherwise("user")
    content = F.when(role == "assistant", _q(F.col("words"))).when(
        role == "user", F.concat(F.lit("["), "parts", F.lit("]"))
    ).otherwise(_q(F.coalesce("output", F.lit(""))))
    tool_calls = F.when(role == "assistant", F.concat(F.lit("["), "calls", F.lit("]")))
    line = _object(
        type=_q(role), id=_q(F.col("id")), tool_call_id=_q(F.col("call")), content=content, tool_calls=tool_calls
    )
    history = chat.select(
        "session", F.lit("chat_history.jsonl").alias("file"), F.col("place").alias("line_no"), line.alias("raw")
    )

    asked = F.row_number().over(Window.partitionBy("session").orderBy("message_idx"))
    users = spoken.where(~mine).select(
        "session",
        "message_idx",
        F.lit(-1).cast("long").alias("at"),
        F.lit("user_message_chunk").alias("kind"),
        F.col("words").alias("text"),
        asked.alias("asked")
    )
    steps = F.when(~call, F.array(F.lit("agent_message_chunk"))).when(
        F.col("status").isNull(), F.array(F.lit("tool_call"))
    ).otherwise(
        F.array(F.lit("tool_call"), F.lit("tool_call_update"))
    )
    own = b.where(mine).select(
        "session",
        "message_idx",
        F.col("nth").alias("at"),
        F.explode(steps).alias("kind"),
        F.when(call, F.coalesce("output", F.lit(""))).otherwise(F.col("text")).alias("text"),
        "native",
        "given",
        "call",
        "status"
    )
    own = own.withColumn("given", F.when(F.col("kind") == "tool_call", F.col("given")))
    events = _placed(users.unionByName(own, allowMissingColumns=True), ["message_idx", "at", "kind"], 0)
    kind, said = F.col("kind"), _object(type=_q("text"), text=_q(F.coalesce("text", F.lit(""))))
    state = F.when(kind == "tool_call", "pending").when(
        kind == "tool_call_update", F.when(F.col("status") == "error", "failed").otherwise("completed")
    )
    body = F.when(kind == "tool_call_update", _list(said)).when(kind != "tool_call", said)
    meta = F.when(kind == "user_message_chunk", _object(promptIndex=(F.col("asked") - 1).cast("string")))
    update = _object(
        sessionUpdate=_q(kind),
        toolCallId=_q(F.col("call")),
        title=F.when(kind == "tool_call", _q(F.col("native"))),
        kind=_q(F.col("native")),
        status=_q(state),
        content=body,
        rawInput=F.col("given"),
        rawOutput=F.when(kind == "tool_call_update", _q(F.col("text"))),
        _meta=meta
    )
    params = _object(sessionId=_q(F.col("session")), update=update, _meta=_object(eventId=_q(F.col("id"))))
    raw = _object(method=_q("session/update"), params=params)
    return history.unionByName(
        events.select(
            "session", F.lit("updates.jsonl").alias("file"), F.col("place").alias("line_no"), raw.alias("raw")
        )
    )
