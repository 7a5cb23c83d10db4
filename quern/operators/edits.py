"""Edits of sessions as new tables: turns deleted, messages rewritten. The input is never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topology import _durable


def deleted_turns(records: DataFrame, turns: DataFrame) -> DataFrame:
    """Records (session, uuid, parent, turn, at and any others) without those turns (session, turn); a record whose
    parent went hangs on the nearest ancestor that is left, or on none. Records without a turn stay. ValueError where
    deleted records are each other's ancestors.

    Only deleted records are joined with each other: their pointers are doubled, so the longest chain of them takes
    the logarithm of its length in rounds.
    """
    asked = turns.select("session", "turn").distinct()
    kept = records.join(asked, ["session", "turn"], "left_anti")
    gone = records.join(asked, ["session", "turn"], "left_semi").where("uuid is not null")
    gone = _durable(gone.groupBy("session", "uuid").agg(F.max_by("parent", "at").alias("up")))
    for _ in range(gone.count().bit_length() + 1):
        above = gone.select("session", F.col("uuid").alias("up"), F.col("up").alias("_up"), F.lit(True).alias("_gone"))
        if gone.join(above, ["session", "up"], "left_semi").isEmpty():
            break
        gone = _durable(
            gone.join(above, ["session", "up"], "left").select(
                "session", "uuid", F.when(F.col("_gone"), F.col("_up")).otherwise(F.col("up")).alias("up")
            )
        )
    else:
        raise ValueError("deleted records run in a circle")
    lost = gone.select("session", F.col("uuid").alias("parent"), "up", F.lit(True).alias("_gone"))
    out = kept.join(lost, ["session", "parent"], "left").withColumn(
        "parent", F.when(F.col("_gone"), F.col("up")).otherwise(F.col("parent"))
    )
    return out.select(*records.columns)


def rewritten(parts: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, refused). Parts (session, uuid, part, type, text and any others) of the messages that `texts` (session,
    uuid, text) names hold the new text where their first text was, and no other. Refused: (session, uuid, reason):
    `stale` for an unknown message, `no_text` for one without a text. The greatest text
    counts where a message is named twice."""
    new = texts.groupBy("session", "uuid").agg(F.max(F.coalesce("text", F.lit(""))).alias("_new"))
    said = F.col("type") == "text"
    known = parts.groupBy("session", "uuid").agg(F.min(F.when(said, F.col("part"))).alias("_first"))
    both = new.join(known.withColumn("_known", F.lit(True)), ["session", "uuid"], "left")
    reason = F.when(F.col("_known").isNull(), "stale").when(F.col("_first").isNull(), "no_text")
    refused = both.withColumn("reason", reason).where("reason is not null").select("session", "uuid", "reason")
    out = parts.join(both.where("_first is not null").drop("_known"), ["session", "uuid"], "left")
    here = F.col("_first").isNotNull() & said
    out = out.where(~F.coalesce(here & (F.col("part") != F.col("_first")), F.lit(False)))
    return out.withColumn("text", F.when(here, F.col("_new")).otherwise(F.col("text"))).select(*parts.columns), refused
