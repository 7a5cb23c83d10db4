"""Canonical tool calls: validity of inputs, fidelity of a move to another format, plan counts, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inputs of the canonical operations: optional, required, or required and not empty (filled), and the
# allowed JSON types.
OPERATIONS = {
    "shell.exec": {
        "command": ("filled", ["string"]),
        "workdir": ("optional", ["string"]),
        "timeout_ms": ("optional", ["int"]),
        "background": ("optional", ["bool"]),
        "sandbox_policy": ("optional", ["string"]),
        "description": ("optional", ["string"]),
    },
    "fs.read": {
        "file_path": ("filled", ["string"]),
        "offset": ("optional", ["int"]),
        "limit": ("optional", ["int"]),
    },
    "fs.write": {
        "file_path": ("filled", ["string"]),
        "content": ("required", ["string"]),
    },
    "fs.edit": {
        "file_path": ("filled", ["string"]),
        "old": ("required", ["string"]),
        "new": ("required", ["string"]),
        "replace_all": ("optional", ["bool"]),
    },
    "fs.patch": {
        "operations": ("required", ["array"]),
        "raw_patch": ("optional", ["string"]),
        "workdir": ("optional", ["string"]),
    },
    "fs.search": {
        "query": ("filled", ["string"]),
        "path": ("optional", ["string"]),
        "glob": ("optional", ["string"]),
        "max_results": ("optional", ["int"]),
    },
    "fs.glob": {
        "pattern": ("filled", ["string"]),
        "path": ("optional", ["string"]),
    },
    "web.fetch": {
        "url": ("filled", ["string"]),
        "method": ("optional", ["string"]),
        "headers": ("optional", ["object"]),
        "body": ("optional", ["string", "object", "array"]),
        "prompt": ("optional", ["string"]),
        "format": ("optional", ["string"]),
        "timeout_ms": ("optional", ["int"]),
    },
    "web.search": {
        "query": ("filled", ["string"]),
        "domains": ("optional", ["array"]),
        "recency_days": ("optional", ["int"]),
        "num_results": ("optional", ["int"]),
    },
    "tool.invoke": {
        "namespace": ("filled", ["string"]),
        "name": ("filled", ["string"]),
        "input": ("required", ["object", "string"]),
        "structure_summary": ("optional", ["object", "string"]),
        "children": ("optional", ["array"]),
    },
    "agent.spawn": {
        "description": ("filled", ["string"]),
        "prompt": ("required", ["string"]),
        "subagent_type": ("filled", ["string"]),
        "task_name": ("optional", ["string"]),
        "model": ("optional", ["string"]),
        "fork_mode": ("optional", ["string"]),
        "fork_turns": ("optional", ["string"]),
        "reasoning_effort": ("optional", ["string"]),
    },
}
# Inputs that only annotate a call, so that losing them loses nothing.
ANNOTATIONS = {"shell.exec": ["description"]}
# Outcome of a loss code.
LOSSES = {
    "migration.children_not_migrated": "dropped",
    "migration.fork_parent_fallback": "degraded",
    "migration.reasoning_dropped": "dropped",
    "migration.reasoning_metadata_dropped": "degraded",
    "migration.truncated": "dropped",
    "migration.unknown_block_dropped": "dropped",
    "session.child_foreign_ignored": "dropped",
    "session.child_parent_conflict": "dropped",
    "session.unpaired_tool_use": "degraded",
}
FIDELITY = ("exact", "transformed", "lossy", "narrated", "dropped")

_KIND = {"string": "STRING", "int": "BIGINT", "bool": "BOOLEAN", "array": "ARRAY<", "object": "OBJECT<"}


def fields(op: str) -> list[tuple[str, bool, bool, list[str]]]:
    """(name, required, not empty, types) of an operation's inputs."""
    return [(name, need != "optional", need == "filled", kinds) for name, (need, kinds) in OPERATIONS[op].items()]


def valid_input(op: str | Column, json: str | Column) -> Column:
    """Whether a call has every required input, not null and where asked not empty, each of an allowed type (a
    boolean is no number). Anything but a JSON object, and an unknown operation, is not valid."""
    op, json = (F.col(x) if isinstance(x, str) else x for x in (op, json))
    v = F.try_parse_json(json)
    out = F.lit(False)
    for name in OPERATIONS:
        good = F.startswith(F.schema_of_variant(v), F.lit("OBJECT<"))
        for field, required, filled, kinds in fields(name):
            x = F.try_variant_get(v, f"$.{field}", "variant")
            absent = x.isNull() | F.is_variant_null(x)
            kind = F.schema_of_variant(x)
            typed = reduce(lambda a, b: a | b, [F.startswith(kind, F.lit(_KIND[k])) for k in kinds])
            if filled:
                typed = typed & (F.try_variant_get(v, f"$.{field}", "string") != "")
            good = good & (F.when(absent, not required).otherwise(typed))
        out = F.when(op == name, F.coalesce(good, F.lit(False))).otherwise(out)
    return out


def rules(spark, target: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """A target's rules as a small dimension: op, base fidelity, inputs that it takes over."""
    rows = [(op, base, taken, ANNOTATIONS.get(op, [])) for op, (base, taken) in target.items()]
    return spark.createDataFrame(rows, "op string, base string, taken array<string>, annotations array<string>")


def decide(
    calls: DataFrame,
    target: DataFrame,
    statuses: list[str],
    native: list[str],
    projected: list[str],
    keeps_attachments: bool = False
) -> DataFrame:
    """Fidelity, reasons and ignored inputs of each call at a target.

    Needs op, input (JSON), status (null without a result), block_kinds, attachments, truncated. An invalid input, an
    operation without a rule, and a result status that is unknown or that the target lacks are narrated; ignored
    inputs, dropped blocks, lost attachments and truncation make an exact or transformed call lossy; projected
    blocks make an exact one transformed.
    """
    keys = F.coalesce(F.json_object_keys("input"), F.array().cast("array<string>"))
    c = calls.withColumn("valid", valid_input("op", "input")).join(F.broadcast(target), "op", "left")
    ignored = F.array_sort(
        F.array_except(
            F.array_except(keys, F.coalesce("taken", F.array().cast("array<string>"))),
            F.coalesce("annotations", F.array().cast("array<string>"))
        )
    )
    has_result = F.col("status").isNotNull()
    kinds = F.coalesce("block_kinds", F.array().cast("array<string>"))
    known = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    is_projected = has_result & (F.size(F.array_intersect(kinds, known(projected))) > 0)
    loses = {
        "unsupported_tool_fields": F.size(ignored) > 0,
        "tool_result_block_dropped": has_result & (F.size(F.array_except(kinds, known([*native, *projected]))) > 0),
        "tool_result_attachments_dropped": has_result & F.coalesce(
            F.col("attachments") > 0, F.lit(False)
        ) & F.lit(not keeps_attachments),
        "tool_result_truncated": has_result & F.coalesce(F.col("truncated"), F.lit(False)),
    }
    why = F.when(~F.col("valid"), "invalid_tool_input").when(F.col("base").isNull(), "tool_to_history").when(
        F.col("base") == "dropped", "tool_unsupported"
    ).when(
        F.col("status") == "unknown", "unknown_result_status"
    ).when(
        has_result & ~F.col("status").isin(statuses), "unsupported_result_status"
    )
    lossy = reduce(lambda a, b: a | b, loses.values())
    fidelity = F.when(why == "tool_unsupported", "dropped").when(why.isNotNull(), "narrated").when(lossy, "lossy").when(
        (F.col("base") == "transformed") | is_projected, "transformed"
    ).otherwise("exact")
    listed = [
        F.when(F.col("base") == "transformed", "tool_transformed"),
        F.when(is_projected, "tool_result_block_degraded"),
        *(F.when(x, name) for name, x in loses.items())
    ]
    reasons = F.when(why.isNotNull(), F.array(why)).otherwise(F.array_compact(F.array(*listed)))
    lost = F.when(why.isNotNull(), F.array_sort(keys)).otherwise(ignored)
    return c.select(*calls.columns, fidelity.alias("fidelity"), reasons.alias("reasons"), lost.alias("ignored"))


def outcome(fidelity: Column) -> Column:
    return F.when(fidelity == "exact", "native").when(fidelity == "dropped", "drop").otherwise("degrade")


def plan(decisions: DataFrame, blocks: DataFrame, losses: DataFrame) -> DataFrame:
    """Counts of a migration: text blocks are exact, images and thinking are dropped, declared losses count by their
    outcome and undeclared ones not at all. Needs decisions.fidelity, blocks.kind, losses.code."""
    text = blocks.where("kind in ('text', 'image', 'thinking')").select(
        F.when(F.col("kind") == "text", "exact").otherwise("dropped").alias("fidelity"), F.lit(True).alias("counted")
    )
    table = F.create_map(*(F.lit(x) for kv in LOSSES.items() for x in kv))
    lost = losses.select(F.element_at(table, F.col("code")).alias("loss")).where("loss is not null")
    rows = decisions.select(
        "fidelity", F.lit(True).alias("counted")
    ).unionByName(text).withColumn("result", outcome(F.col("fidelity")))
    rows = rows.unionByName(
        lost.select(
            F.lit(None).cast("string").alias("fidelity"),
            F.lit(False).alias("counted"),
            F.when(F.col("loss") == "dropped", "drop").otherwise("degrade").alias("result")
        )
    )
    return rows.agg(
        *(F.count(F.when(F.col("result") == r, 1)).alias(r) for r in ("native", "degrade", "drop")),
        *(F.count(F.when(F.col("fidelity") == f, 1)).alias(f) for f in FIDELITY)
    )
