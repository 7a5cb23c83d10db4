"""What a migration would change, as rows: every block, call or loss of a tree that does not arrive as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import narrated
from . import dialects
from .tools import LOSSES
from .topology import closure

# Characters of a summary and of the detail beside it.
SUMMARY, DETAIL = 180, 2500


def node_paths(nodes: DataFrame) -> DataFrame:
    """(session, path): the places of a node and its ancestors among their siblings, from 0 for the root, like 0.2.1.
    Nodes: session, parent (null for a root) and ordinal, their order among siblings."""
    place = F.row_number().over(Window.partitionBy("parent").orderBy("ordinal", "session")) - 1
    placed = nodes.select("session", "parent", F.when(F.col("parent").isNull(), 0).otherwise(place).alias("place"))
    pairs = closure(placed.select(F.col("session").alias("id"), F.col("parent").alias("parent_id")))
    steps = pairs.join(placed.select(F.col("session").alias("ancestor"), "place"), "ancestor")
    way = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "place")))
    return steps.groupBy(F.col("node").alias("session")).agg(
        F.array_join(F.transform(way, lambda x: x["place"].cast("string")), ".").alias("path")
    )


def snapshot(text: Column, kind: str, label: Column) -> Column:
    """What is shown of one side: its text on one line, cut, and in full up to a bound."""
    line = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    cut = lambda c, n, mark: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)
    fields = [
        F.lit(kind).alias("kind"),
        label.alias("label"),
        cut(line, SUMMARY, "…").alias("summary"),
        cut(text, DETAIL, "\n…").alias("detail")
    ]
    return F.struct(
        *fields, (F.length(text) > DETAIL).alias("truncated"), F.length(text).cast("long").alias("char_count")
    )


def _call_text(json: Column, output: Column) -> Column:
    return F.to_json(F.struct(F.try_parse_json(json).alias("input"), F.coalesce(output, F.lit("")).alias("output")))


def differences(nodes: DataFrame, blocks: DataFrame, decided: DataFrame, losses: DataFrame, target: str) -> DataFrame:
    """One row per difference. Nodes: session, parent, ordinal, title; blocks: session, message_idx (from 1), block_idx,
    role, kind, text, name; decided: the tool blocks with op, input, output and what `tools.decide` says of them (fidelity,
    reasons, ignored); losses: session, code, detail; target: the format that is moved to.

    Calls that are not exact are degraded or dropped, images and thinking are dropped, and losses count where their code
    is declared. A difference is anchored to its round (of which the first also holds what comes before the first user)
    where anything of the round is shown. Order: by node_path, message_index and block_index, losses behind them.
    """
    key = F.concat(F.lit("n:"), "path")
    place = nodes.select(
        "session", F.coalesce("title", F.lit("")).alias("node_title")
    ).join(node_paths(nodes), "session").withColumn("node_key", key)
    of_message = blocks.groupBy("session", "message_idx").agg(F.min("role").alias("role"))
    so_far = Window.partitionBy("session").orderBy("message_idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rounds = of_message.withColumn(
        "round_index",
        F.greatest(F.lit(1), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(so_far)).cast("long")
    )
    at = ["session", "message_idx", "block_idx"]
    tools = decided.select(*at, "name", "op", "input", "output", "fidelity", "reasons", "ignored")
    text = blocks.where("kind = 'text' and text <> ''").select(*at)
    seen = text.unionByName(tools.where("fidelity <> 'dropped'").select(*at)).join(rounds, ["session", "message_idx"])
    seen = seen.select("session", "round_index").distinct().withColumn("shown", F.lit(True))

    native, given = dialects.render(target, F.col("op"), F.col("input"))
    told = narrated(F.coalesce("name", F.lit("")), F.coalesce("input", F.lit("")), F.col("output"))
    rendered = snapshot(
        _call_text(F.coalesce(given, F.col("input")), F.col("output")), "tool", F.coalesce(native, F.lit("history"))
    )
    history = snapshot(told, "text", F.lit("history"))
    moved = F.col("fidelity").isin("transformed", "lossy")
    keys = F.coalesce(F.json_object_keys("input"), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    calls = tools.where("fidelity <> 'exact'").select(
        *at, "fidelity", F.col("reasons").alias("reason_codes"), F.array_sort(
            F.array_except(keys, "ignored")
        ).alias("consumed_fields"), F.col("ignored").alias("ignored_fields"),
        snapshot(_call_text(F.col("input"), F.col("output")), "tool", F.col("name")).alias("source"),
        F.when(moved, rendered).when(F.col("fidelity") == "narrated", history).alias("target"),
    )
    empty = F.lit(None).cast(calls.schema["target"].dataType)
    silent = blocks.where("kind in ('image', 'thinking')")
    kind = F.col("kind")
    source = F.when(
        kind == "thinking", snapshot(F.coalesce("text", F.lit("")), "thinking", F.lit("thinking"))
    ).otherwise(snapshot(F.coalesce("text", F.lit("")), "image", F.coalesce("name", F.lit("image"))))
    silent = silent.select(
        *at,
        F.lit("dropped").alias("fidelity"),
        F.array(F.concat(F.lit("unsupported_"), kind)).alias("reason_codes"),
        none.alias("consumed_fields"),
        none.alias("ignored_fields"),
        source.alias("source"),
        empty.alias("target")
    )
    inside = calls.unionByName(silent).join(rounds, ["session", "message_idx"]).join(
        seen, ["session", "round_index"], "left"
    ).join(place, "session")
    message = F.concat("node_key", F.lit("/m:"), F.col("message_idx") - 1)
    anchor = F.when(F.col("shown"), F.concat("node_key", F.lit("/r:"), "round_index"))
    inside = inside.select(
        F.concat(
            message, F.lit("/b:"), "block_idx", F.lit("/difference")
        ).alias("id"), F.when(
            F.col("fidelity") == "dropped", "dropped"
        ).otherwise("degraded").alias("kind"), "fidelity",
        F.get(
            "reason_codes", F.lit(0)
        ).alias(
            "reason_code"
        ), "reason_codes", "consumed_fields", "ignored_fields", F.lit("block").alias("scope"), "node_key", F.col("session").alias("node_id"),
        "node_title", F.col("path").alias("node_path"), "round_index", message.alias("message_key"), (
            F.col("message_idx") - 1
        ).cast("long").alias("message_index"),
        F.col("block_idx").cast("long").alias("block_index"), "role", anchor.alias("anchor_id"), "source", "target",
    )
    outcomes = F.create_map(*(F.lit(x) for kv in LOSSES.items() for x in kv))
    nth = F.row_number().over(Window.partitionBy("session").orderBy("code", "detail")) - 1
    lost = losses.withColumn("nth", nth).withColumn(
        "kind", F.try_element_at(outcomes, F.col("code"))
    ).where("kind is not null").join(place, "session")
    text, long = F.lit(None).cast("string"), F.lit(None).cast("long")
    lost = lost.select(
        F.concat("node_key", F.lit("/loss:"), "nth").alias("id"), "kind", F.when(
            F.col("kind") == "degraded", "narrated"
        ).otherwise("dropped").alias("fidelity"), F.col("code").alias("reason_code"),
        F.array("code").alias("reason_codes"), none.alias(
            "consumed_fields"
        ), none.alias("ignored_fields"), F.lit("node").alias("scope"), "node_key", F.col("session").alias("node_id"),
        "node_title", F.col("path").alias("node_path"), long.alias(
            "round_index"
        ), text.alias("message_key"), long.alias(
            "message_index"
        ), long.alias("block_index"), text.alias("role"), text.alias("anchor_id"),
        snapshot(F.coalesce("detail", F.lit("")), "event", F.col("code")).alias("source"), empty.alias("target"),
    )
    return inside.unionByName(lost)
