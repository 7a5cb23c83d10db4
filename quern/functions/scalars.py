"""Scalar expressions over messages, tool results and native values. Built-ins, but for `bounded_json`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types of images, and caps in characters of what a runtime keeps.
IMAGE_TYPES = ("image/png", "image/jpeg", "image/gif", "image/webp")
RUNTIME_CAPS = {
    "text": 16_000, "thinking": 16_000, "tool_result": 4_000, "image": 64_000, "delta": 16_000, "prompt": 16_000
}
#: Native result states by format. What is not listed is `unknown`.
STATUSES = {
    "claude": {
        "success": "success",
        "completed": "success",
        "teammate_spawned": "success",
        "error": "error",
        "interrupted": "interrupted",
        "running": "running",
        "async_launched": "running",
        "pending": "pending",
    },
    "opencode": {"completed": "success", "error": "error", "running": "running", "pending": "pending"},
    "grok": {"completed": "success", "failed": "error", "pending": "pending"},
}
_PLAIN_WORD = r"^[A-Za-z0-9@%+=:,./_-]+$"


def byte_clip(text: Column, size: int) -> tuple[Column, Column]:
    """(the longest prefix of whole characters in `size` bytes of UTF-8, whether anything was cut)."""
    raw = F.encode(text, "UTF-8")
    parts = [F.try_validate_utf8(F.substring(raw, 1, size - k).cast("string")) for k in range(min(4, size + 1))]
    return F.when(F.octet_length(text) <= size, text).otherwise(F.coalesce(*parts)), F.octet_length(text) > size


def around(text: Column, at: Column, before: int, after: int) -> Column:
    """Characters from `before` in front of position `at` (from 1) to `after` behind it, an ellipsis at each cut."""
    lo, hi = F.greatest(F.lit(1), at - before), F.least(F.length(text), at - 1 + after)
    cut = F.when(lo > 1, "…").otherwise(""), F.when(hi < F.length(text), "…").otherwise("")
    return F.concat(cut[0], text.substr(lo, hi - lo + 1), cut[1])


def session_snippet(text: Column, terms: list[str], before: int = 240, after: int = 560, most: int = 900) -> Column:
    """Surroundings of the first hit of any term, at most `most` characters; null without a hit."""
    at = F.array_min(F.filter(F.array(*(F.locate(t.lower(), F.lower(text)) for t in terms)), lambda p: p > 0))
    return F.when(at.isNotNull(), F.substring(around(text, at, before, after), 1, most))


def regex_snippet(text: Column, span: Column, before: int = 120, after: int = 240) -> Column:
    """Surroundings of a match (at, length); null without one."""
    at = span["at"]
    lo, hi = F.greatest(F.lit(1), at - before), F.least(F.length(text), at - 1 + span["length"] + after)
    cut = F.when(lo > 1, "…").otherwise(""), F.when(hi < F.length(text), "…").otherwise("")
    return F.when(at > 0, F.concat(cut[0], text.substr(lo, hi - lo + 1), cut[1]))


def _ascii_json(json: Column) -> Column:
    """Characters beyond ASCII as escapes of 16-bit units."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        high, low = F.shiftright(n - 0x10000, 10) + 0xD800, (n - 0x10000).bitwiseAND(0x3FF) + 0xDC00
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(json.rlike(r"^[\x00-\x7F]*$"), json).otherwise(
        F.array_join(F.transform(F.split(json, ""), escaped), "")
    )


def revision(tool: Column, ref: Column, updated: Column, size: Column, identity: Column | None = None) -> Column:
    """SHA-256 of the compact JSON of a row's identity, keys in order, nulls kept."""
    identity = identity if identity is not None else F.lit(None).cast("string")
    fields = F.struct(
        identity.alias("file_identity"),
        ref.alias("ref"),
        size.alias("size"),
        tool.alias("tool"),
        updated.alias("updated")
    )
    return F.sha2(_ascii_json(F.to_json(fields, {"ignoreNullFields": "false"})), 256)


def ordered_digest(item: Column) -> Column:
    """SHA-256 of a group's sorted items (an aggregate for groups of bounded size: files of a session)."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "\n"), 256)


def result_text(blocks: Column) -> Column:
    """Text of a tool result: of each block (kind, text, data as JSON) its text, of a JSON block without text its data."""
    one = lambda b: F.when(b["text"] != "", b["text"]).when((b["kind"] == "json") & b["data"].isNotNull(), b["data"])
    return F.coalesce(F.array_join(F.filter(F.transform(blocks, one), lambda t: t != ""), "\n"), F.lit(""))


def extracted(blocks: Column, cap: int = 16_000) -> Column:
    """(text, tool_text, clipped) of a message's blocks (kind, text, name, output), each at most `cap` characters."""
    text = F.array_join(
        F.transform(F.filter(blocks, lambda b: (b["kind"] == "text") & (b["text"] != "")), lambda b: b["text"]), "\n"
    )
    tools = F.filter(blocks, lambda b: b["kind"] == "tool")
    said = lambda b: F.concat_ws(
        "\n", F.concat(F.lit("[tool "), b["name"], F.lit("]")), F.nullif(b["output"], F.lit(""))
    )
    tool_text = F.array_join(F.transform(tools, said), "\n")
    clipped = (F.length(text) > cap) | (F.length(tool_text) > cap)
    return F.struct(
        F.substring(text, 1, cap).alias("text"),
        F.substring(tool_text, 1, cap).alias("tool_text"),
        clipped.alias("clipped")
    )


def result_status(tool: str, native: Column, is_error: Column, interrupted: Column, exit_code: Column) -> Column:
    """Canonical state of a native result; the order of the tests is the format's own."""
    table = F.create_map(*(F.lit(x) for kv in STATUSES[tool].items() for x in kv))
    mapped = F.coalesce(F.try_element_at(table, native), F.lit("unknown"))
    if tool == "claude":
        plain = F.when(native.isNull(), "success").otherwise(mapped)
        return F.when(F.coalesce(is_error, F.lit(False)), "error").when(
            F.coalesce(interrupted, F.lit(False)), "interrupted"
        ).otherwise(plain)
    if tool == "opencode":
        state = F.when(F.coalesce(interrupted, F.lit(False)), "interrupted").otherwise(mapped)
        return F.when((state == "unknown") & F.coalesce(is_error, F.lit(False)), "error").otherwise(state)
    return F.when((mapped == "success") & (F.coalesce(exit_code, F.lit(0)) != 0), "error").otherwise(mapped)


def patch_changes(patch: Column) -> Column:
    """Changes of a patch text: (operation, path, destination, hunks); an update with a move line is a move."""
    header = r"\*\*\* (?:Add|Update|Delete) File: [^\r\n]+"
    parts = F.slice(
        F.split(F.concat(F.lit("\n"), F.replace(patch, F.lit("\r\n"), F.lit("\n"))), rf"\n(?={header})"), 2, 1 << 30
    )

    def change(part: Column) -> Column:
        operation = F.lower(F.regexp_extract(part, r"^\*\*\* (Add|Update|Delete) File: ", 1))
        path = F.trim(F.regexp_extract(part, r"^\*\*\* (?:Add|Update|Delete) File: ([^\r\n]+)", 1))
        target = F.nullif(F.trim(F.regexp_extract(part, r"(?m)^\*\*\* Move to: ([^\r\n]+)", 1)), F.lit(""))
        moves = (operation == "update") & target.isNotNull()
        hunks = F.regexp_count(part, F.lit(r"(?m)^@@")).cast("long")
        return F.struct(
            F.when(moves, "move").otherwise(operation).alias("operation"),
            path.alias("path"),
            F.when(moves, target).alias("destination"),
            hunks.alias("hunks")
        )

    return F.transform(parts, change)


def to_int(value: Column) -> Column:
    """A number or its text, cut to a whole number; anything else is null. Whole numbers of up to 28 digits are exact on
    the way, so every long is; other numbers go through double."""
    exact, rough = value.try_cast("decimal(38,10)"), value.try_cast("double")
    cut = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).try_cast("long")
    return F.when(exact.isNotNull(), cut(exact)).when(F.abs(rough) < 2.0**63, cut(rough))


def to_bool(value: Column) -> Column:
    """true and false in any case; anything else is null."""
    return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)


def sandbox_policy(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "dangerously-disable").otherwise("default")


def image_of(url: Column) -> Column:
    """(mime_type, data) of a data URL that holds a known image type and whole base64; null otherwise."""
    pattern = r"^data:([^;,]+);base64,([A-Za-z0-9+/=]+)$"
    mime, data = F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)
    whole = (F.length(data) % 4 == 0) & data.rlike(r"^[A-Za-z0-9+/]+={0,2}$")
    return F.when(mime.isin(*IMAGE_TYPES) & whole, F.struct(mime.alias("mime_type"), data.alias("data")))


def narrated(name: Column, source: Column, output: Column) -> Column:
    """A tool call told as history: input to 500 characters, output to 2000."""
    said = F.substring(F.coalesce(F.nullif(output, F.lit("")), F.lit("(no output)")), 1, 2000)
    return F.concat(
        F.lit("[History: tool "),
        name,
        F.lit(" was previously invoked]\nInput: "),
        F.substring(source, 1, 500),
        F.lit("\nResult:\n"),
        said
    )


def visible_text(text: Column) -> Column:
    """The text, or null where it is blank."""
    return F.when(~text.rlike(r"(?U)^\s*$"), text)


def shell_word(word: Column) -> Column:
    """A word quoted for a shell where it needs it."""
    return F.when(word.rlike(_PLAIN_WORD), word).otherwise(
        F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    )


def in_workdir(command: Column, workdir: Column) -> Column:
    """The command after a change of directory, the directory quoted for a shell where it needs it."""
    return F.when(F.coalesce(workdir, F.lit("")) == "", command).otherwise(
        F.concat(F.lit("cd "), shell_word(workdir), F.lit(" && "), command)
    )


def merged_metadata(current: Column, patch: Column) -> Column:
    """Maps of JSON texts: the patch wins, then empty values (null, false, zero, "", []) are dropped."""
    both = F.map_concat(F.map_filter(current, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch)
    return F.map_filter(
        both, lambda k, v: v.isNotNull() & ~F.trim(v).isin("null", "false", '""', "[]", "0", "0.0", "-0.0")
    )


def json_args(raw: Column) -> tuple[Column, Column]:
    """(whether the arguments are a JSON object, their text: {} for nothing)."""
    text = F.coalesce(F.nullif(raw, F.lit("")), F.lit("{}"))
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT<")), F.lit(False)), text


def kept(text: Column, kind: str) -> tuple[Column, Column]:
    """(what a runtime keeps of a text of this kind, whether it was cut)."""
    return F.substring(text, 1, RUNTIME_CAPS[kind]), F.length(text) > RUNTIME_CAPS[kind]


def unwrapped(raw: Column) -> Column:
    """(text, exit_code, stderr) of a typed output envelope in JSON; text is null where it does not open. Byte lists
    are decoded as UTF-8."""
    v = F.try_parse_json(raw)
    kind = F.try_variant_get(v, "$.type", "string")
    text = lambda path: F.when(
        F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string")
    )

    def stream(path: str) -> Column:
        codes = F.try_variant_get(v, path, "array<int>")
        fits = F.forall(codes, lambda c: c.isNotNull() & c.between(0, 255))
        joined = F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
        return F.coalesce(text(path), F.when(F.coalesce(fits, F.lit(False)), F.make_valid_utf8(joined.cast("string"))))

    edits = F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.EditsApplied", "variant")), F.lit("OBJECT<"))
    out = (
        F.when(kind == "ReadFile", text("$.FileContent.content"))
        .when(kind == "ListDir", text("$.Content.content"))
        .when(kind == "Text", text("$.text"))
        .when(kind == "Todo", text("$.TodosUpdated.summary_for_prompt"))
        .when(kind == "SearchReplace", F.when(edits, ""))
        .when(kind == "Bash", F.coalesce(stream("$.output"), text("$.output_for_prompt")))
        .when(kind == "GrepSearch", stream("$.stdout"))
    )
    coded = out.isNotNull() & kind.isin("Bash", "GrepSearch")
    code = F.when(coded, F.try_variant_get(v, "$.exit_code", "int"))
    return F.struct(
        out.alias("text"),
        code.alias("exit_code"),
        F.when(coded & (kind == "GrepSearch"), F.nullif(stream("$.stderr"), F.lit(""))).alias("stderr")
    )


def _bounded(value, depth: int, left: list[int]):
    if left[0] <= 0 or depth > 8:
        return None, True
    left[0] -= 1
    if isinstance(value, list):
        got = [_bounded(x, depth + 1, left) for x in value[:200]]
        return [x for x, _ in got], len(value) > 200 or any(cut for _, cut in got)
    if isinstance(value, dict):
        got = {k: _bounded(x, depth + 1, left) for k, x in list(value.items())[:200]}
        return {k: x for k, (x, _) in got.items()}, len(value) > 200 or any(cut for _, cut in got.values())
    return value, False


def bounded_json(json: Column, most: int = 32 * 1024) -> Column:
    """JSON of bounded depth (8), items (200 a level) and nodes (2000), marked where it was cut; beyond `most` bytes a
    digest and a preview. Needs a walk in document order, so it is a vectorised function."""

    @F.pandas_udf("string")
    def run(texts):
        import hashlib
        from json import dumps, loads

        def one(text):
            if text is None:
                return None
            value, cut = _bounded(loads(text), 0, [2000])
            out = dumps({"truncated": True, "value": value} if cut else value, ensure_ascii=False, sort_keys=True)
            raw = out.encode()
            if len(raw) <= most:
                return out
            preview = raw[: min(4000, max(0, most - 256))].decode(errors="ignore")
            return dumps(
                {"truncated": True, "sha256": hashlib.sha256(raw).hexdigest(), "preview": preview}, ensure_ascii=False
            )

        return texts.map(one)

    return run(json)
