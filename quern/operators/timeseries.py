"""Activity over time. `now` is always an argument; days and hours are those of the session time zone (UTC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clock(rows: DataFrame, at: str) -> DataFrame:
    """24 bins; peak marks the first of the largest."""
    hours = rows.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = rows.groupBy(F.hour(at).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    out = hours.join(F.broadcast(counts), "hour", "left").fillna(0, ["n"])
    first = F.max_by("hour", F.struct("n", (-F.col("hour")).alias("early"))).over(Window.partitionBy())
    return out.withColumn("peak", F.col("hour") == first)


def night_share(rows: DataFrame, at: str) -> DataFrame:
    night = (F.hour(at) >= 21) | (F.hour(at) <= 4)
    return rows.agg(
        F.count(F.when(night, 1)).alias("night"),
        F.count(F.lit(1)).alias("total"),
        F.round(F.count(F.when(night, 1)) / F.count(F.lit(1)), 6).alias("share")
    )


def heatmap(rows: DataFrame, at: str, now: str, weeks: int = 52) -> DataFrame:
    """weeks x 7 cells, Monday first, the week of `now` last; a day after `now` counts -1."""
    today = F.to_date(F.lit(now))
    monday = F.date_sub(today, F.expr(f"weekday(date'{now[:10]}')"))
    days = rows.sparkSession.range(weeks * 7).select(
        F.date_add(F.date_sub(monday, 7 * (weeks - 1)), F.col("id").cast("int")).alias("day"),
        F.floor(F.col("id") / 7).cast("int").alias("week"),
        (F.col("id") % 7).cast("int").alias("weekday")
    )
    span = F.to_date(at).between(F.date_sub(monday, 7 * (weeks - 1)), F.date_add(monday, 6))
    counts = rows.where(span).groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    out = days.join(F.broadcast(counts), "day", "left")
    return out.select(
        "week",
        "weekday",
        "day",
        F.when(F.col("day") > today, -1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n")
    )


def trends(rows: DataFrame, at: str, now: str, days: int = 14, parity: bool = False) -> DataFrame:
    """Daily buckets up to today (bucket 0): calendar days, or with `parity` the rule that drops what is later than
    today's midnight and puts a midnight into the day it ends."""
    buckets = rows.sparkSession.range(days).select(F.col("id").cast("int").alias("bucket"))
    if parity:
        age = F.floor(
            (
                F.unix_micros(F.to_timestamp(F.to_date(F.lit(now)))) - F.unix_micros(F.col(at).cast("timestamp"))
            ) / 86_400_000_000
        )
    else:
        age = F.datediff(F.to_date(F.lit(now)), F.to_date(at))
    counts = rows.withColumn("bucket", age.cast("int")).where(
        F.col("bucket").between(0, days - 1)
    ).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")
    )
    return buckets.join(F.broadcast(counts), "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("value", F.lit(0.0)), 6).alias("value")
    )


def streaks(rows: DataFrame, key: str, at: str, now: str) -> DataFrame:
    """Longest run of active days, and the run that reaches today or yesterday."""
    days = rows.select(key, F.to_date(at).alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    runs = days.withColumn("island", island).groupBy(key, "island").agg(
        F.count(F.lit(1)).alias("n"), F.max("day").alias("last")
    )
    live = F.datediff(F.to_date(F.lit(now)), F.col("last")).between(0, 1)
    return runs.groupBy(key).agg(
        F.max("n").alias("longest"), F.coalesce(F.max(F.when(live, F.col("n"))), F.lit(0)).alias("current")
    )


def bump(rows: DataFrame, at: str, now: str, months: int = 6, k: int = 4) -> DataFrame:
    """Rank of the k largest models in each calendar month on a dense grid; fewer than two models give nothing."""
    first = F.add_months(F.trunc(F.to_date(F.lit(now)), "MM"), -(months - 1))
    m = rows.where(F.to_date(at) >= first).groupBy(
        "model", F.trunc(F.to_date(at), "MM").alias("month")
    ).agg(F.sum("tokens").alias("tokens"))
    top = m.groupBy("model").agg(F.sum("tokens").alias("total")).orderBy(F.desc("total"), "model").limit(k)
    top = top.withColumn(
        "place", F.row_number().over(Window.partitionBy().orderBy(F.desc("total"), "model"))
    ).withColumn("models", F.count(F.lit(1)).over(Window.partitionBy())).where("models >= 2")
    grid = top.withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(months - 1)))
    ).withColumn("month", F.add_months(first, F.col("step")))
    full = grid.join(m, ["model", "month"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("tokens"), "place"))
    return full.select("model", "month", "tokens", rank.cast("long").alias("rank"))


def time_bucket(at, now: str):
    """today, yesterday, last7, last30 or earlier, by calendar day."""
    age = F.datediff(F.to_date(F.lit(now)), F.to_date(at))
    return F.when(age <= 0, "today").when(
        age == 1, "yesterday"
    ).when(age < 7, "last7").when(age < 30, "last30").otherwise("earlier")
