"""References to other sessions inside records, at any depth and inside strings that hold JSON; what they prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agents import descendants
from .topology import _counted, _durable

#: Keys whose strings name a session, and keys whose strings may hold JSON.
THREAD_KEYS = (
    "threadId",
    "thread_id",
    "agent_thread_id",
    "sender_thread_id",
    "new_thread_id",
    "parent_thread_id",
    "child_thread_id",
    "session_id",
    "forked_from_id"
)
JSON_KEYS = ("arguments", "output", "input", "metadata", "state")


def thread_references(records: DataFrame, known: DataFrame) -> DataFrame:
    """(session, ref): the ids of `known` (id) that the records (session, raw) name under a thread key. Values are opened
    level by level, all records at once: objects, lists (whose items keep the list's key), and strings under a key that
    may hold JSON. A record that is no JSON names nothing; names count once."""
    work = records.select("session", F.lit(None).cast("string").alias("key"), F.try_parse_json("raw").alias("v"))
    found = None
    while True:
        kind = F.schema_of_variant("v")
        work, left = _counted(
            work.where("v is not null").withColumn(
                "kind",
                F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(kind)
            ),
            "session"
        )
        if not left:
            break
        text = work.where("kind = 'STRING'").select(
            "session", "key", F.try_variant_get("v", "$", "string").alias("text")
        )
        named = text.where(F.col("key").isin(*THREAD_KEYS)).select("session", F.col("text").alias("ref")).distinct()
        found = named if found is None else found.unionByName(named)
        packed = text.where(F.col("key").isin(*JSON_KEYS) & F.substring("text", 1, 1).isin("[", "{"))
        none = F.lit(None).cast("string")
        inner = packed.select("session", none.alias("key"), F.try_parse_json("text").alias("v"))
        items = work.where("kind = 'array'").select(
            "session", "key", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v")
        )
        fields = work.where("kind = 'object'").select(
            "session", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "v")
        )
        work = inner.unionByName(items).unionByName(fields)
    ids = known.select(F.col("id").alias("ref")).distinct()
    return (
        found if found is not None else ids.select(F.lit(None).cast("string").alias("session"), "ref").limit(0)
    ).distinct().join(ids, "ref", "left_semi").select("session", "ref")


def pruned(nodes: DataFrame, anchor: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept nodes, removed ids) after an edit of `anchor` (id): children of it that `references` (ref) still name go,
    with everything below them. Nodes: id, parent_id and any others."""
    direct = nodes.join(anchor.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
    asked = direct.join(references.select(F.col("ref").alias("id")).distinct(), "id", "left_semi")
    removed = _durable(descendants(nodes, asked).select("id").distinct())
    return nodes.join(removed, "id", "left_anti"), removed
