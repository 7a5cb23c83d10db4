"""Live index: file arrivals to deltas with a generation, and settled change tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import StateTable, apply_delta


def stream_rows(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def delta_sink(
    table: StateTable, keys: list[str], revision: str, emit: Callable[[int, DataFrame], None]
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the newest row per key is merged into the table, the version is the generation, and
    only rows that changed are emitted; a row older than the table's changes nothing. A delta is emitted before its
    version is written: after a crash between the two the batch runs again and emits it again (at least once, with the
    same generation), it is never lost. `emit` must therefore take a generation twice."""

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), revision).alias("r")).select("r.*")
        if not table.version():
            emit(1, rows.select(*keys, F.lit("upsert").alias("op")))
            table.replace(rows, 0)
            return
        version, have = table.version(), table.read()
        known = have.select(*keys, F.col(revision).alias("_known"))
        newer = rows.join(known, keys, "left").where(
            F.col("_known").isNull() | (F.col(revision) > F.col("_known"))
        ).drop("_known")
        changed = newer.select(*keys, F.lit("upsert").alias("op"))
        if not changed.isEmpty():
            emit(version + 1, changed)
            table.replace(apply_delta(have, newer, newer.limit(0), keys), version)

    return merge


def windowed_counts(events: DataFrame, at: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event-time tumbling counts with a watermark for late rows."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), key, "n"
    )
