"""Moving sessions between formats: edges of agents, differences, trees, checks of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topology import _durable, forest


def linked_edges(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls with their agent edge: the first of the same call id, else of the same agent (or child session), else the
    only edge that the call's message spawned. Calls: session, call_id, agent_id, message_id; edges: session, edge_id,
    source_call_id, agent_id, child_session_id, spawn_message_id, ordinal."""
    first = lambda key: edges.where(F.col(key).isNotNull()).groupBy("session", F.col(key).alias("_k")).agg(
        F.min_by(F.struct("ordinal", "edge_id"), "ordinal").alias("_e")
    )
    by_call = first("source_call_id").select(
        "session", F.col("_k").alias("call_id"), F.col("_e.edge_id").alias("_call")
    )
    agents = first("agent_id").unionByName(
        first("child_session_id")
    ).groupBy("session", "_k").agg(F.min("_e").alias("_e"))
    by_agent = agents.select("session", F.col("_k").alias("agent_id"), F.col("_e.edge_id").alias("_agent"))
    spawned = edges.where("spawn_message_id is not null").groupBy(
        "session", F.col("spawn_message_id").alias("message_id")
    )
    by_message = spawned.agg(
        F.count(F.lit(1)).alias("_n"), F.min("edge_id").alias("_message")
    ).where("_n = 1").drop("_n")
    out = calls.join(by_call, ["session", "call_id"], "left").join(by_agent, ["session", "agent_id"], "left").join(
        by_message, ["session", "message_id"], "left"
    )
    return out.withColumn("edge_id", F.coalesce("_call", "_agent", "_message")).drop("_call", "_agent", "_message")


def difference_counts(differences: DataFrame) -> DataFrame:
    return differences.groupBy("fidelity").agg(F.count(F.lit(1)).alias("n"))


def matching_differences(differences: DataFrame, needle: str, fidelity: str | None = None) -> DataFrame:
    """Differences of one fidelity whose texts (title, path, role, reason, labels, summaries) hold the needle."""
    fields = (
        "node_title",
        "node_path",
        "role",
        "fidelity",
        "reason_code",
        "source_label",
        "source_summary",
        "target_label",
        "target_summary"
    )
    text = F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in fields if c in differences.columns)))
    out = differences.where(F.contains(text, F.lit(needle.strip().lower())))
    return out.where(F.col("fidelity") == fidelity) if fidelity else out


def consecutive_groups(rows: DataFrame, partition: str, order: str, key: Column) -> DataFrame:
    """Numbers the runs of equal `key` in order, within each partition."""
    w = Window.partitionBy(partition).orderBy(order)
    change = F.when(F.lag("_key").over(w).eqNullSafe(F.col("_key")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    out = rows.withColumn("_key", key).withColumn("_change", change)
    return out.withColumn(
        "group_no", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")
    ).drop("_key", "_change")


def tree_counts(sessions: DataFrame, messages: DataFrame, edges: DataFrame) -> DataFrame:
    """By root: sessions, messages and edges of the tree. Sessions: id, parent_id."""
    top = forest(sessions).select(F.col("top").alias("root"), F.col("node").alias("session"))
    m = messages.groupBy("session").agg(F.count(F.lit(1)).alias("_m"))
    e = edges.groupBy("session").agg(F.count(F.lit(1)).alias("_e"))
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    return top.join(m, "session", "left").join(e, "session", "left").groupBy("root").agg(
        F.count(F.lit(1)).alias("nodes"), zero("_m").alias("messages"), zero("_e").alias("edges")
    )


def kept_children(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose spawning message is still there (edges without one stay)."""
    here = kept.select(
        "session", F.col("source_id").alias("spawn_message_id")
    ).distinct().withColumn("_kept", F.lit(True))
    return edges.join(
        here, ["session", "spawn_message_id"], "left"
    ).where("spawn_message_id is null or _kept").drop("_kept")


def remapped(rows: DataFrame, columns: list[str], ids: DataFrame) -> DataFrame:
    """Ids of these columns replaced where `ids` (old, new) knows them."""
    for c in columns:
        known = ids.select(F.col("old").alias(c), F.col("new").alias("_new"))
        rows = rows.join(known, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new").select(*rows.columns)
    return rows


def broken_invariants(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """What an edit broke: (session, problem, id) of repeated ids, unknown parents, results without a call, calls
    without a result. Records: session, uuid, parent; blocks: session, type, id (of the call)."""
    problem = lambda df, name: df.select("session", F.lit(name).alias("problem"), "id")
    ids = records.where("uuid is not null").groupBy(
        "session", F.col("uuid").alias("id")
    ).agg(F.count(F.lit(1)).alias("n"))
    parents = records.where("parent is not null").select("session", F.col("parent").alias("id")).distinct()
    of = lambda kind: blocks.where(F.col("type") == kind).select("session", "id").distinct()
    out = problem(ids.where("n > 1"), "repeated_id").unionByName(
        problem(parents.join(ids, ["session", "id"], "left_anti"), "unknown_parent")
    )
    out = out.unionByName(
        problem(of("tool_result").join(of("tool_use"), ["session", "id"], "left_anti"), "orphan_result")
    )
    return out.unionByName(
        problem(of("tool_use").join(of("tool_result"), ["session", "id"], "left_anti"), "unpaired_call")
    )


def strict_closure(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """(root, node, digest) over parents from files and a registry. ValueError where the two contradict each other, an
    id is repeated, a parent is missing or a tree runs in a circle. The digest is that of a tree's sorted ids."""
    if not nodes.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("an id is repeated")
    both = nodes.select("id", "parent_id").join(registry.select("id", F.col("parent_id").alias("_r")), "id", "left")
    if not both.where("parent_id <> _r").isEmpty():
        raise ValueError("file and registry name different parents")
    tree = both.select("id", F.coalesce("parent_id", "_r").alias("parent_id"))
    if not tree.where("parent_id is not null").join(
        tree.select(F.col("id").alias("parent_id")), "parent_id", "left_anti"
    ).isEmpty():
        raise ValueError("a parent is missing")
    reached = _durable(forest(tree).select(F.col("top").alias("root"), "node", "parent"))
    if not tree.where("parent_id is not null").join(
        reached.where("parent is null").select(F.col("node").alias("id")), "id", "left_semi"
    ).isEmpty():
        raise ValueError("a tree runs in a circle")
    reached = reached.drop("parent")
    digest = reached.groupBy("root").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("node")), "\n"), 256).alias("digest")
    )
    return reached.join(digest, "root")


def nested_parts(messages: DataFrame, parts: DataFrame, key: str, order: str) -> DataFrame:
    """Messages with an ordered list of their parts (empty where there are none)."""
    fields = [c for c in parts.columns if c not in (key, order)]
    lists = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("parts"))
    out = messages.join(lists, key, "left")
    return out.withColumn("parts", F.coalesce("parts", F.array().cast(lists.schema["parts"].dataType)))


def flagged(rows: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """`rows` with a flag for those that `keys` holds."""
    return rows.join(
        keys.select(*on).distinct().withColumn(name, F.lit(True)), on, "left"
    ).withColumn(name, F.coalesce(name, F.lit(False)))
