"""A stream source that reads what was appended to line files, by byte offset.

The driver looks at sizes and at the last block of each file that grew (for the end of its last whole line); the lines
themselves are read by tasks, a byte range each.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset bigint, raw string"
#: Bytes of a task, bytes that a batch takes of one file at most, and of a look for a line end.
STEP = 8 << 20
MOST = 1 << 30
LOOK = 1 << 16


class Range(InputPartition):
    def __init__(self, path: str, first: int, start: int, end: int, last: int):
        self.path, self.first, self.start, self.end, self.last = path, first, start, end, last


def _line_end(path: str, start: int, size: int) -> int:
    """The end of the last whole line in [start, size), `start` where there is none."""
    with open(path, "rb") as f:
        at = size
        while at > start:
            lo = max(start, at - LOOK)
            f.seek(lo)
            cut = f.read(at - lo).rfind(b"\n")
            if cut >= 0:
                return lo + cut + 1
            at = lo
    return start


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern = options["path"]
        self.step, self.most = int(options.get("step", STEP)), int(options.get("most", MOST))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Whole lines only: an unfinished last line waits. A file that has shrunk is read from its beginning."""
        end = dict(self.seen)
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            size, at = os.path.getsize(path), self.seen.get(path, 0)
            at = 0 if size < at else at
            upto = _line_end(path, at, min(size, at + self.most))
            # a line longer than a batch takes is waited for as a whole
            end[path] = upto if upto > at or size <= at + self.most else _line_end(path, at, size)
        self.seen = end
        return end

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path in sorted(end):
            first, last = int(start.get(path, 0)), int(end[path])
            first = 0 if last < first else first
            out += [Range(path, first, at, min(last, at + self.step), last) for at in range(first, last, self.step)]
        self.seen = {**self.seen, **{p: int(n) for p, n in end.items()}}
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        """Lines that start in the range; the last one may end behind it."""
        with open(partition.path, "rb") as f:
            at = partition.start
            if at > partition.first:
                f.seek(at - 1)
                at = at - 1 + len(f.readline())
            else:
                f.seek(at)
            while at < partition.end:
                line = f.readline(partition.last - at)
                if line.strip():
                    yield partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)
                if not line:
                    break

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class TailSource(DataSource):
    """`spark.readStream.format("quern_tail")` with the option path: a glob on a file system that the driver and every
    executor reach."""

    @classmethod
    def name(cls) -> str:
        return "quern_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return TailReader(self.options)


def tail(spark: SparkSession, pattern: str) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("quern_tail").option("path", pattern).load()


def tailed_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """`tail` with the columns that the folds of transcripts take: a line's offset is its place, and where it starts is
    the size of its file so far."""
    t = tail(spark, pattern)
    return t.select(
        "file",
        F.col("offset").alias("line_no"),
        "raw",
        F.col("offset").alias("size"),
        F.lit(None).cast("long").alias("modified_ms")
    )
