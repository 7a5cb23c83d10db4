"""Native tool calls to canonical operations and back, by tables of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Native tool -> (operation, canonical input -> native names, the first is written). Names listed under
# SECONDS are milliseconds that the format keeps in seconds.
DIALECTS = {
    "claude": {
        "Bash": (
            "shell.exec",
            {
                "command": ["command"],
                "timeout_ms": ["timeout"],
                "background": ["run_in_background"],
                "description": ["description"]
            }
        ),
        "Read": ("fs.read", {"file_path": ["file_path"], "offset": ["offset"], "limit": ["limit"]}),
        "Write": ("fs.write", {"file_path": ["file_path"], "content": ["content"]}),
        "Edit": (
            "fs.edit",
            {"file_path": ["file_path"], "old": ["old_string"], "new": ["new_string"], "replace_all": ["replace_all"]}
        ),
        "Grep": (
            "fs.search", {"query": ["pattern"], "path": ["path"], "glob": ["glob"], "max_results": ["head_limit"]}
        ),
        "Glob": ("fs.glob", {"pattern": ["pattern"], "path": ["path"]}),
        "WebFetch": ("web.fetch", {"url": ["url"], "prompt": ["prompt"]}),
        "WebSearch": ("web.search", {"query": ["query"], "domains": ["allowed_domains"]}),
        "Agent": (
            "agent.spawn",
            {
                "description": ["description"],
                "prompt": ["prompt"],
                "subagent_type": ["subagent_type"],
                "task_name": ["name"],
                "model": ["model"],
                "fork_mode": ["mode"],
                "reasoning_effort": ["reasoning_effort"]
            }
        ),
    },
    "opencode": {
        "bash": (
            "shell.exec",
            {
                "command": ["command"],
                "workdir": ["workdir"],
                "timeout_ms": ["timeout"],
                "background": ["run_in_background"],
                "description": ["description"]
            }
        ),
        "read": ("fs.read", {"file_path": ["filePath"], "offset": ["offset"], "limit": ["limit"]}),
        "write": ("fs.write", {"file_path": ["filePath"], "content": ["content"]}),
        "edit": (
            "fs.edit",
            {"file_path": ["filePath"], "old": ["oldString"], "new": ["newString"], "replace_all": ["replaceAll"]}
        ),
        "grep": ("fs.search", {"query": ["pattern"], "path": ["path"], "glob": ["include"], "max_results": ["limit"]}),
        "glob": ("fs.glob", {"pattern": ["pattern"], "path": ["path"]}),
        "webfetch": ("web.fetch", {"url": ["url"], "format": ["format"], "timeout_ms": ["timeout"]}),
        "websearch": ("web.search", {"query": ["query"], "num_results": ["numResults"]}),
    },
    "pi": {
        "bash": ("shell.exec", {"command": ["command"], "timeout_ms": ["timeout"]}),
        "read": ("fs.read", {"file_path": ["path", "file_path"], "offset": ["offset"], "limit": ["limit"]}),
        "write": ("fs.write", {"file_path": ["path", "file_path"], "content": ["content"]}),
        "grep": ("fs.search", {"query": ["pattern"], "path": ["path"], "glob": ["glob"], "max_results": ["limit"]}),
        "find": ("fs.glob", {"pattern": ["pattern"], "path": ["path"]}),
    },
    "codex": {
        "shell": (
            "shell.exec",
            {"command": ["command"], "workdir": ["workdir"], "timeout_ms": ["timeout_ms"], "background": ["background"]}
        ),
        "shell_command": (
            "shell.exec",
            {"command": ["command"], "workdir": ["workdir"], "timeout_ms": ["timeout_ms"], "background": ["background"]}
        ),
        "exec": (
            "shell.exec",
            {"command": ["command"], "workdir": ["workdir"], "timeout_ms": ["timeout_ms"], "background": ["background"]}
        ),
        "exec_command": (
            "shell.exec",
            {"command": ["command"], "workdir": ["workdir"], "timeout_ms": ["timeout_ms"], "background": ["background"]}
        ),
        "read_file": ("fs.read", {"file_path": ["path"], "offset": ["start_line"], "limit": ["limit"]}),
    },
    "grok": {
        "run_terminal_command": (
            "shell.exec",
            {
                "command": ["command"],
                "description": ["description"],
                "timeout_ms": ["timeout"],
                "background": ["is_background"]
            }
        ),
        "Shell": (
            "shell.exec",
            {
                "command": ["command"],
                "description": ["description"],
                "workdir": ["working_directory"],
                "timeout_ms": ["block_until_ms"]
            }
        ),
        "read_file": ("fs.read", {"file_path": ["target_file"], "offset": ["offset"], "limit": ["limit"]}),
        "Read": ("fs.read", {"file_path": ["path"], "offset": ["offset"], "limit": ["limit"]}),
        "write": ("fs.write", {"file_path": ["file_path"], "content": ["content"]}),
        "Write": ("fs.write", {"file_path": ["path"], "content": ["contents"]}),
        "search_replace": (
            "fs.edit",
            {"file_path": ["file_path"], "old": ["old_string"], "new": ["new_string"], "replace_all": ["replace_all"]}
        ),
        "StrReplace": (
            "fs.edit",
            {"file_path": ["path"], "old": ["old_string"], "new": ["new_string"], "replace_all": ["replace_all"]}
        ),
        "grep": (
            "fs.search", {"query": ["pattern"], "path": ["path"], "glob": ["glob"], "max_results": ["head_limit"]}
        ),
        "Grep": (
            "fs.search", {"query": ["pattern"], "path": ["path"], "glob": ["glob"], "max_results": ["head_limit"]}
        ),
        "Glob": ("fs.glob", {"pattern": ["glob_pattern"], "path": ["target_directory"]}),
        "web_fetch": ("web.fetch", {"url": ["url"]}),
        "WebFetch": ("web.fetch", {"url": ["url"]}),
        "web_search": ("web.search", {"query": ["query"], "domains": ["allowed_domains"]}),
        "WebSearch": ("web.search", {"query": ["search_term"]}),
    },
}
# Native tools that are read and never written.
READ_ONLY = {
    "codex": ["shell_command", "exec", "exec_command", "read_file"],
    "grok": ["Shell", "Read", "Write", "StrReplace", "Grep", "Glob", "WebFetch", "WebSearch"],
}
SECONDS = {"pi": ["timeout_ms"]}


def bindings(tool: str) -> list[tuple[str, str, list[tuple[str, list[str], bool]]]]:
    """(native tool, operation, [(canonical input, native names, kept in seconds)])."""
    seconds = SECONDS.get(tool, [])
    return [
        (native, op, [(c, names, c in seconds) for c, names in inputs.items()]) for native,
        (op, inputs) in DIALECTS[tool].items()
    ]


def _json(fields: list[tuple[str, Column]]) -> Column:
    """A JSON object of the fields that are not null."""
    return F.to_json(F.struct(*(value.alias(name) for name, value in fields)))


def _scaled(v: Column, path: str, factor: str) -> Column:
    """A number times `factor`; whole results stay whole, what is no number is left out."""
    number = F.when(
        F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("BIGINT|DECIMAL|DOUBLE"),
        F.try_variant_get(v, path, "decimal(30,6)")
    )
    return number * F.expr(factor)


def parse(tool: str, name: Column, json: Column) -> tuple[Column, Column]:
    """(canonical operation, canonical input as JSON) of a native call. A call whose tool has no row, or whose input
    is no object, is a tool.invoke that carries it whole."""
    v = F.try_parse_json(json)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), F.lit(False))
    op, out = F.lit("tool.invoke"), _json([("namespace", F.lit(tool)), ("name", name), ("input", v)])
    for native, operation, inputs in bindings(tool):
        value = []
        for canonical, names, seconds in inputs:
            found = [F.try_variant_get(v, f"$.{n}", "variant") for n in names]
            found = [F.when(~F.is_variant_null(x), x) for x in found]
            value.append(
                (canonical, _scaled(v, f"$.{names[0]}", "1000").cast("bigint") if seconds else F.coalesce(*found))
            )
        hit = (name == native) & is_object
        op, out = F.when(hit, operation).otherwise(op), F.when(hit, _json(value)).otherwise(out)
    return op, out


def render(tool: str, op: Column, json: Column) -> tuple[Column, Column]:
    """(native tool, native input as JSON) of a canonical call; nulls where the format has no row for it. A
    tool.invoke of the same format gives back what it carries."""
    v = F.try_parse_json(json)
    own = (op == "tool.invoke") & (F.try_variant_get(v, "$.namespace", "string") == tool)
    name, out = F.when(own, F.try_variant_get(v, "$.name", "string")), F.when(
        own, F.to_json(F.try_variant_get(v, "$.input", "variant"))
    )
    for native, operation, inputs in bindings(tool):
        if native in READ_ONLY.get(tool, []):
            continue
        value = [
            (
                names[0],
                _scaled(
                    v, f"$.{c}", "cast(0.001 as decimal(10,6))"
                ).cast("double") if seconds else F.try_variant_get(v, f"$.{c}", "variant")
            ) for c,
            names,
            seconds in inputs
        ]
        name, out = F.when(op == operation, native).otherwise(name), F.when(
            op == operation, _json(value)
        ).otherwise(out)
    return name, out


def unmapped(tool: str, op: Column, json: Column) -> Column:
    """Canonical inputs that a format has no name for, sorted."""
    known = F.lit(None).cast("array<string>")
    for native, operation, inputs in bindings(tool):
        if native in READ_ONLY.get(tool, []):
            continue
        known = F.when(op == operation, F.array(*(F.lit(c) for c, _, _ in inputs))).otherwise(known)
    return F.array_sort(
        F.array_except(
            F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")),
            F.coalesce(known, F.array().cast("array<string>"))
        )
    )
