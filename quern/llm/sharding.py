"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

A table is a folder of shards and of manifests `manifest-<version>.json`. A manifest lists the shards that make
up the table in that version (an entry of about a hundred bytes a shard); shards are never changed. Every commit
writes the next manifest under a temporary name and renames it, which fails if another writer took the version, so
readers see whole versions only. This needs a file system whose rename does not overwrite (HDFS, local disks); on
an object store without one, commits need a store with create-if-absent or a single writer.

Arrivals are appended as small shards. Compaction looks at the manifest (sizes of files, never at rows): shards
below the target fall into tiers of like size, and the shards of a tier that has enough of them are merged by one
Spark job: the Parquet reader packs whole files, largest first, into tasks of at most the target size, and every
task writes one file, so nothing is shuffled. Replaced shards stay until `vacuum`.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET = 128 << 20
#: Ratio of sizes within a tier, and shards of a tier that start a merge.
FANOUT = 4
#: Bytes of an arriving shard before encoding, about, and shards that one job merges at most (their names pass
#: through the driver).
ARRIVAL_BYTES = 4 << 20
JOB_SHARDS = 50_000
#: Hours that a shard outside every manifest is kept: another writer may be about to commit it.
GRACE_HOURS = 24


class ShardTable:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _list(self) -> list[str]:
        at = self._jvm.org.apache.hadoop.fs.Path(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    # manifests -------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self._list() if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (the latest by default); an empty table is version 0 without shards."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._p(f"manifest-{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, base: dict, shards: list[dict], schema: str) -> int:
        version = base["version"] + 1
        temporary, final = self._p(f"_next-{uuid.uuid4().hex}"), self._p(f"manifest-{version}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": shards}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"version {version} was committed by another writer; reread and try again")
        return version

    # writes ----------------------------------------------------------------------------------

    def _write(self, df: DataFrame, rows: int | None = None) -> list[dict]:
        folder = f"shards-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows or 0).parquet(f"{self.path}/{folder}")
        # listed by Spark: names and sizes, no contents
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.path}/{folder}")
        names = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length").orderBy("file").toArrow().to_pylist()
        return [{"file": f"{folder}/{r['file']}", "bytes": r["length"]} for r in names]

    def _arrival_rows(self, df: DataFrame) -> int:
        """Rows that fill a shard: by the mean length of a row's texts and binaries, and eight bytes for any other column."""
        long = {f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")}
        size = F.lit(8 * (len(df.columns) - len(long)))
        for name in long:
            size = size + F.coalesce(F.octet_length(F.col(f"`{name.replace('`', '``')}`")), F.lit(0))
        mean = df.agg(F.avg(size)).first()[0]
        return max(1, int(ARRIVAL_BYTES / max(mean or 1, 1)))

    def append(self, df: DataFrame, rows: int | None = None) -> int:
        """Adds the rows of `df` as new shards of `rows` rows at most (as many as make ARRIVAL_BYTES, if not given) and
        commits; an empty `df` commits its schema alone. Columns go by name; a column that is missing, more than the table has, or of another type is refused
        with ValueError before anything is written."""
        base = self.manifest()
        schema = base["schema"] or df.schema.json()
        have, want = ({f.name: f.dataType for f in x.fields} for x in (df.schema, StructType.fromJson(json.loads(schema))))
        if have != want:
            raise ValueError(f"the table's columns are {want}, not {have}")
        df = df.select(*(F.col(f"`{name.replace('`', '``')}`") for name in want))
        return self._commit(base, base["shards"] + self._write(df, rows or self._arrival_rows(df)), schema)

    def tier(self, size: int) -> int:
        """0 from the target on; otherwise 1, 2, ... for each factor of the fan-out below it."""
        return 0 if size >= self.target else 1 + int(math.log(self.target / max(size, 1)) / math.log(self.fanout))

    def plan(self, manifest: dict) -> list[list[dict]]:
        """Shards to merge, by tier: those of each tier of at least `fanout` shards that share a task with another."""
        tiers: dict[int, list[dict]] = {}
        for shard in manifest["shards"]:
            if t := self.tier(shard["bytes"]):
                tiers.setdefault(t, []).append(shard)
        out = []
        for shards in (tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout):
            merged, run, size = [], [], 0
            for shard in [*sorted(shards, key=lambda s: (-s["bytes"], s["file"])), None]:
                if shard is None or size + shard["bytes"] > self.target:
                    merged += run if len(run) > 1 else []
                    run, size = [], 0
                if shard:
                    run.append(shard)
                    size += shard["bytes"]
            if merged:
                out.append(merged)
        return out

    def _files(self, shards: list[dict], schema: str, spark: SparkSession | None = None) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return (spark or self.spark).read.schema(kind).parquet(*(f"{self.path}/{s['file']}" for s in shards))

    def _packing(self) -> SparkSession:
        """A session whose readers fill tasks with whole files up to the target size."""
        own = self.spark.newSession()
        settings = {"maxPartitionBytes": self.target, "openCostInBytes": 0, "minPartitionNum": 1}
        for name, value in settings.items():
            own.conf.set(f"spark.sql.files.{name}", str(value))
        return own

    def compact(self) -> int:
        """Merges until no tier holds `fanout` mergeable shards, or a round would not make fewer shards than it takes
        (its files then stay outside every manifest, for `vacuum`); each round is one commit. Returns the version. A
        round that fails or is cut off leaves the last version as it was. A table that needs no merge is not changed."""
        packing = self._packing()
        while tiers := self.plan(base := self.manifest()):
            made = []
            for shards in tiers:
                for at in range(0, len(shards), JOB_SHARDS):
                    made += self._write(self._files(shards[at : at + JOB_SHARDS], base["schema"], packing))
            gone = {s["file"] for shards in tiers for s in shards}
            if len(made) >= len(gone):
                return base["version"]
            self._commit(base, [s for s in base["shards"] if s["file"] not in gone] + made, base["schema"])
        return base["version"]

    def vacuum(self, grace_hours: float = GRACE_HOURS) -> int:
        """Deletes earlier manifests, and shards that the latest version does not list and that are older than the
        grace period. Returns how many shards went; an empty table loses nothing."""
        latest = self.manifest()
        live, gone = {s["file"] for s in latest["shards"]}, 0
        for folder in self._list():
            if not folder.startswith("shards-"):
                continue
            files = self._fs.listStatus(self._p(folder))
            dead = [f.getPath() for f in files if f"{folder}/{f.getPath().getName()}" not in live]
            if any(f.getModificationTime() > (time.time() - 3600 * grace_hours) * 1000 for f in files):
                continue
            if len(dead) == len(files):
                self._fs.delete(self._p(folder), True)
            else:
                for path in dead:
                    self._fs.delete(path, False)
            gone += len(dead)
        for v in self.versions()[:-1]:
            self._fs.delete(self._p(f"manifest-{v}.json"), False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. Nulls, empty texts, repeated rows and any columns come back as they were written."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the table has no version yet")
        return self._files(m["shards"], m["schema"])
