"""Reconciliation of snapshots, and state tables kept as versioned Parquet with a single writer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Allowed moves of an operation plan.
MOVES = {
    "planned": ("queued", "cancelled", "expired"),
    "queued": ("applying", "cancelled"),
    "applying": ("applied", "failed"),
    "applied": (),
    "failed": (),
    "cancelled": (),
    "expired": ()
}


def reconcile(current: DataFrame, stored: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """Each key is new, changed, same or missing."""
    c = current.select(*keys, F.col(revision).alias("_now"), F.lit(1).alias("_c"))
    s = stored.select(*keys, F.col(revision).alias("_was"), F.lit(1).alias("_s"))
    state = F.when(F.col("_s").isNull(), "new").when(F.col("_c").isNull(), "missing").when(
        F.col("_now").eqNullSafe(F.col("_was")), "same"
    ).otherwise("changed")
    return c.join(s, keys, "full_outer").select(*keys, state.alias("state"))


def delta(before: DataFrame, after: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """upserts and removals that turn `before` into `after`."""
    r = reconcile(after, before, keys, revision)
    return r.where("state <> 'same'").select(
        *keys, F.when(F.col("state") == "missing", "removal").otherwise("upsert").alias("op")
    )


def apply_delta(before: DataFrame, upserts: DataFrame, removals: DataFrame, keys: list[str]) -> DataFrame:
    gone = removals.select(*keys).union(upserts.select(*keys)).distinct()
    return before.join(gone, keys, "left_anti").unionByName(upserts)


def can_move(state: str, to: str) -> bool:
    return to in MOVES.get(state, ())


class StateTable:
    """A keyed table in numbered Parquet folders: every change writes the next version; `expected` makes a change
    conditional on the version that was read (compare and set). One driver writes at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration()
        )

    def version(self) -> int:
        at = self._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        v = version or self.version()
        if not v:
            raise ValueError("the table is empty")
        return self.spark.read.parquet(f"{self.path}/v{v}")

    def replace(self, df: DataFrame, expected: int | None = None) -> int:
        v = self.version()
        if expected is not None and expected != v:
            raise RuntimeError(f"version is {v}, not {expected}")
        temporary = f"{self.path}/_next-{uuid.uuid4().hex}"
        df.write.parquet(temporary)
        p = self._jvm.org.apache.hadoop.fs.Path
        if self._fs.exists(p(f"{self.path}/v{v + 1}")) or not self._fs.rename(p(temporary), p(f"{self.path}/v{v + 1}")):
            raise RuntimeError("another writer took the version")
        return v + 1

    def upsert(self, rows: DataFrame, expected: int | None = None) -> int:
        if not self.version():
            return self.replace(rows, expected)
        return self.replace(apply_delta(self.read(), rows, rows.limit(0), self.keys), expected)

    def delete(self, keys: DataFrame, expected: int | None = None) -> int:
        return self.replace(self.read().join(keys.select(*self.keys), self.keys, "left_anti"), expected)

    def insert_idempotent(self, rows: DataFrame, payload: str) -> int:
        """Inserts unknown keys; a known key with another payload is an error."""
        if not self.version():
            return self.replace(rows)
        have = self.read()
        clash = have.join(
            rows.select(*self.keys, F.col(payload).alias("_new")), self.keys
        ).where(~F.col(payload).eqNullSafe(F.col("_new")))
        if not clash.isEmpty():
            raise ValueError("a known key has another payload")
        return self.replace(have.unionByName(rows.join(have, self.keys, "left_anti")))

    def move(self, where, to: str, state: str = "status") -> int:
        """Compare and set of a state column along the allowed moves."""
        sources = [s for s, targets in MOVES.items() if to in targets]
        v = self.version()
        hit = where & F.col(state).isin(sources)
        if self.read(v).where(hit).isEmpty():
            raise RuntimeError(f"no row may move to {to}")
        return self.replace(self.read(v).withColumn(state, F.when(hit, F.lit(to)).otherwise(F.col(state))), v)
