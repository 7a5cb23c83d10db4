"""Helpers shared by the corpus operators: durable intermediate tables, row seeds and text kernels.

The text kernels work on the raw UTF-8 buffers of Arrow string columns, a bounded slice of bytes at a
time, so memory in a Python worker depends on the slice (or on the longest single text), never on the
number of rows in a partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of text that a kernel works on at once; a single longer text is its own slice.
SLICE_BYTES = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_FILE = 20_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset a machine-local folder serves a local master
    only: on a cluster the executors would not see each other's files, so this raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = "file:///tmp/checkpoints/quern"
    return f"{root.rstrip('/')}/quern-{uuid.uuid4().hex}"


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: later steps reread files, not the lineage.

    With an estimate of its rows, narrow rows are written in files of about ROWS_PER_FILE.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    (df if rows is None else df.coalesce(max(8, rows // ROWS_PER_FILE))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(rows: DataFrame, n: int, salt: int, by: str | None = None) -> DataFrame:
    """The `n` distinct rows of least hashed doc_id (for each value of `by`, if given), all where there are fewer.

    Repeated rows count once, a null id hashes like any value, an empty table gives no rows. Rows whose hash cannot
    be among the chosen are left out before anything is sorted, so about 2 * n rows (for each value) meet in one
    task, whatever the number of rows and of tasks.
    """
    key = F.xxhash64("doc_id", F.lit(salt))
    place = key.cast("double") / 2.0**64 + 0.5
    seen = F.approx_count_distinct("doc_id", 0.02)
    if by is None:
        return rows.where(place <= _reach(n, max(1, rows.agg(seen).first()[0]))).distinct().orderBy(key, "doc_id").limit(n)
    counts = rows.groupBy(F.col(by).alias("_by")).agg(_reach(n, F.greatest(F.lit(1), seen)).alias("_reach"))
    near = rows.join(counts, F.col(by) == F.col("_by")).where(place <= F.col("_reach")).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(key, "doc_id"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank", "_by", "_reach")


def _reach(n: int, seen):
    """Share of the hash range that holds `n` of about `seen` ids: a fifth more for the error of the count, and ten
    standard deviations more for chance."""
    return (1.2 * n + 10 * (n + 100) ** 0.5) / seen


#: Rows and bytes of an Arrow batch: texts may be long, and a batch is held several times on its way to Python and back.
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """The schema of `df` and these fields after it, whatever the names of its columns hold."""
    return StructType([*df.schema.fields, *(StructField(name, DataType.fromDDL(kind)) for name, kind in kinds.items())])


def map_texts(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of few rows and bytes (session settings, lowered where they are larger). Columns whose names hold
    a dot or a backtick, which mapInArrow cannot take, pass under plain names and get theirs back."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    odd = {c: f"quern_{k}" for k, c in enumerate(df.columns) if "`" in c or "." in c}
    if not odd:
        return df.mapInArrow(function, schema)
    plain = StructType([StructField(odd.get(f.name, f.name), f.dataType) for f in schema.fields])
    return df.toDF(*(odd.get(c, c) for c in df.columns)).mapInArrow(function, plain).toDF(*schema.names)


#: Groups of a thousandth of all rows or more: a thousand of them at most, whatever the number of rows.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """`rows` with the columns of `groups` (one row per value of `key`, null included) but `count`, the rows of the
    group. Rows of values that are not in `groups` get nulls; no rows give none.

    Groups that hold a thousandth of what `groups` counts, or more, are at most 1000: they are broadcast, so their rows
    stay where they are. The others, of less than a thousandth each, meet their rows by a shuffle.
    """
    groups = materialize(groups.withColumnRenamed(key, "quern_key"))
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    is_hot = F.col(count) * HOT_SHARE >= total
    hot, rest = F.broadcast(groups.where(is_hot).drop(count)), groups.where(~is_hot).drop(count)
    meets = F.col(key).eqNullSafe(F.col("quern_key"))
    others = rows.join(hot.select("quern_key"), meets, "left_anti").join(rest, meets, "left")
    return rows.join(hot, meets).unionByName(others).drop("quern_key")


# ---------------------------------------------------------------------------------------------
# slices of string columns

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of the column, null as empty; offsets start at 0."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        a, b = offsets[lo], offsets[hi]
        yield lo, hi, data[a:b], offsets[lo : hi + 1] - a
        lo = hi


# ---------------------------------------------------------------------------------------------
# 64-bit word hashes by prefix sums of a polynomial

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, shift, xor)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _byte_table(fold: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold:
        t[65:91] = t[97:123]
    return t


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        with np.errstate(over="ignore"):
            _TABLES.update(fold=_byte_table(True), exact=_byte_table(False), up=_powers(_P, _CHUNK + 1), down=_powers(_P_INV, _CHUNK + 1))
    return _TABLES


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never crosses the end of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_WS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    before |= edge[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    after |= edge[1:]
    return np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span (A-Z folded to a-z when `fold`); spans are sorted and apart."""
    t = _tables()
    table, up, down = t["fold" if fold else "exact"], t["up"], t["down"]
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _CHUNK, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        if b - a > _CHUNK:  # one word longer than a chunk: in pieces, each hashed and then combined
            h = np.uint64(0)
            for p in range(a, b, _CHUNK):
                part = table[data[p : min(b, p + _CHUNK)]]
                h = mix(np.array([h + (part * up[: len(part)]).sum(dtype=np.uint64)], np.uint64))[0]
            out[lo] = h
        else:
            acc = np.zeros(b - a + 1, np.uint64)
            np.cumsum(table[data[a:b]] * up[: b - a], out=acc[1:])
            s = starts[lo:hi] - a
            out[lo:hi] = (acc[ends[lo:hi] - a] - acc[s]) * down[s]
        lo = hi
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice, and for each text the index of its first word (one more at the end)."""
    with np.errstate(over="ignore"):
        starts, ends = word_bounds(data, offsets)
        return span_hashes(data, starts, ends, fold), np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words; a shorter text is one run."""
    if not len(h):
        return h
    w = min(width, len(h))
    with np.errstate(over="ignore"):
        acc = h[: len(h) - w + 1].copy()
        for k in range(1, w):
            acc = acc * np.uint64(0xA24BAED4963EE407) + h[k : len(h) - w + 1 + k]
        return mix(acc ^ np.uint64(w))
