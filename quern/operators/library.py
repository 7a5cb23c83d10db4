"""Library views: metadata joins, protection, groups, facets, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topology import _durable


def with_metadata(rows: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(metadata, keys, "left")


def protection(pinned: Column, archived: Column, tagged: Column) -> Column:
    """The first cause that protects a row from deletion."""
    return F.when(pinned, "pinned").when(archived, "archived").when(tagged, "tagged")


def delete_preview(rows: DataFrame, cause: str, size: str) -> DataFrame:
    """How many rows and bytes a deletion would take and how many are protected."""
    free = F.col(cause).isNull()
    return rows.agg(
        F.count(F.when(free, 1)).alias("deletable"),
        F.coalesce(F.sum(F.when(free, F.col(size))), F.lit(0)).cast("long").alias("bytes"),
        F.count(F.when(~free, 1)).alias("protected")
    )


def groups(rows: DataFrame, pinned: Column, bucket: Column) -> DataFrame:
    """Pinned first, then time buckets from today to earlier."""
    name = F.when(pinned, "pinned").otherwise(bucket)
    place = F.when(name == "pinned", 0).when(name == "today", 1).when(
        name == "yesterday", 2
    ).when(name == "last7", 3).when(name == "last30", 4).otherwise(5)
    return rows.select("*", name.alias("group_name"), place.alias("group_place"))


def facets(rows: DataFrame, tool: str, place: str, order: str, places: int = 6) -> DataFrame:
    """Counts by tool, and the first `places` distinct places in order of appearance."""
    tools = rows.groupBy(F.col(tool).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at")
    ).withColumn("facet", F.lit("tool"))
    first = rows.groupBy(F.col(place).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at")
    ).orderBy("first_at").limit(places).withColumn("facet", F.lit("place"))
    return tools.unionByName(first)


def history_status(rolled_back: Column, probe_failed: Column, session: Column) -> Column:
    return F.when(rolled_back, "rolled_back").when(
        probe_failed, "probe_failed"
    ).when(session.isNotNull(), "done").otherwise("failed")


def flows(moves: DataFrame, src: str, dst: str, k: int = 5) -> DataFrame:
    return moves.groupBy(src, dst).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), src, dst).limit(k)


def ranking(rows: DataFrame, place: str, tool: str, tools: list[str], k: int = 6) -> DataFrame:
    """The k busiest places with one column per tool."""
    counts = [F.count(F.when(F.col(tool) == t, 1)).alias(f"n_{t}") for t in tools]
    return rows.groupBy(place).agg(F.count(F.lit(1)).alias("n"), *counts).orderBy(F.desc("n"), place).limit(k)


def newest(rows: DataFrame, keys: list[str], at: str, ordinal: str) -> DataFrame:
    """One row per key: the newest, the later of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(ordinal))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """All rows with their `place` (long, from 1) in an order. Rows are dealt by ranges of the order and numbered within
    each; only the counts of the ranges meet in one task. The ranges are written once, as they are drawn from samples."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _durable(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = dealt.withColumn("place", own).join(F.broadcast(starts), "_range")
    return numbered.withColumn("place", F.col("_start") + F.col("place")).drop("_range", "_start")
