"""Vector code compression: product codes whose nearest entries are found by vector approximation files.

Each part position has a codebook. Its entries are known to the search by the cells of a grid first: a table per
query holds the least and the largest squared distance to every cell of every coordinate, sums of which bound the
distance to each entry from both sides. Only entries whose lower bound does not exceed the least upper bound are
compared by their integer distances. Rounds of assignment and update send sums per entry to the driver, never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import join_groups, map_texts, materialize, with_fields
from .whitening import matrix, usable, whole_numbers

#: Bits of a cell, by coordinate.
CELL_BITS = 4
#: Vectors that are compared at once.
SLICE = 2048
#: A scaled component must be below 2 to this power, so that sums of squared distances of 256 dimensions fit a long.
COMPONENT_BITS = 26


class CellFile:
    """The entries of one codebook (k rows of w whole numbers) by their grid cells."""

    def __init__(self, book: np.ndarray):
        self.book, cells = book, 1 << CELL_BITS
        low = book.min(axis=0)
        side = (book.max(axis=0) - low) // cells + 1
        self.cell = (book - low) // side
        self.first = low[:, None] + np.arange(cells) * side[:, None]
        self.last = self.first + side[:, None] - 1

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of every query to every entry."""
        q = queries[:, :, None]
        near = np.maximum(np.maximum(self.first - q, q - self.last), 0)
        far = np.maximum(np.abs(q - self.first), np.abs(q - self.last))
        near, far = near * near, far * far
        lower = np.zeros((len(queries), len(self.book)), np.int64)
        upper = lower.copy()
        for at in range(self.book.shape[1]):
            lower += near[:, at, self.cell[:, at]]
            upper += far[:, at, self.cell[:, at]]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of every query (ties to the lower index), its squared distance, and how many were refined."""
        lower, upper = self.bounds(queries)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        away = queries[row] - self.book[entry]
        distance = (away * away).sum(axis=1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == best[row])
        first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
        return entry[first], best, len(row)


def _parts(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, block of rows x parts x width) of column x."""
    rows = matrix(batch, "x")
    if rows.shape[1] != parts * width:
        raise ValueError("vectors of unequal length")
    for lo in range(0, len(rows), SLICE):
        yield lo, rows[lo : lo + SLICE].reshape(-1, parts, width)


def _sums(books: np.ndarray):
    parts, k, width = books.shape

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [CellFile(b) for b in books]
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for _, block in _parts(batch, parts, width):
                for p in range(parts):
                    entry = files[p].nearest(block[:, p])[0]
                    counts[p] += np.bincount(entry, minlength=k)
                    np.add.at(sums[p], entry, block[:, p])
        part, entry, at = (a.reshape(-1) for a in np.meshgrid(np.arange(parts), np.arange(k), np.arange(width), indexing="ij"))
        used = counts[part, entry] > 0
        part, entry, at = part[used], entry[used], at[used]
        columns = [part.astype(np.int32), entry.astype(np.int32), at.astype(np.int32), sums[part, entry, at], counts[part, entry]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "at", "total", "n"])

    return total


def update(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts x entries x width) after one round: assign, then floor(sum / count) by entry."""
    sums = rows.select("x").transform(map_texts, _sums(books), "part int, entry int, at int, total long, n long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.part, r.entry, r["at"]] = r.total // r.n
    return out


def train(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """Codebooks of column x: the parts of the rows of smallest vec_id (nulls last, then by x), moved `rounds` times.

    None where there are no rows. Reruns agree: sums are whole numbers.
    """
    first = rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    if not first:
        return None
    if len({len(r.x) for r in first}) > 1 or len(first[0].x) % parts:
        raise ValueError(f"vectors of unequal length, or not of a multiple of {parts} components")
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = update(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal text by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _coder(books: np.ndarray):
    parts, _, width = books.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [CellFile(b) for b in books]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes, errors = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for lo, block in _parts(batch, parts, width):
                for p in range(parts):
                    entry, distance, _ = files[p].nearest(block[:, p])
                    codes[lo : lo + len(block), p] = entry
                    errors[lo : lo + len(block)] += distance
            names = [name for name in batch.schema.names if name != "x"]
            columns = [batch.column(batch.schema.get_field_index(name)) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)], names=[*names, "code", "error"])

    return code


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The columns of `rows` but x, with code (two hex digits a part) and error (squared distances summed over parts)."""
    return rows.transform(map_texts, _coder(books), with_fields(rows.drop("x"), code="string", error="long"))


def compressed(vectors: DataFrame, scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    A component c counts as floor(scale * c). Vectors that are null or empty or hold a null or a component that is not
    finite take no part. Repeated rows count as often as they occur; rows that share an id are ordered by their
    vectors where codebooks start; a null vec_id comes after all others. With fewer than `entries` rows the
    codebooks have one entry a row. label_error sums the error over rows of equal label, nulls together. An empty table
    gives no rows; other columns are ignored. Vectors of unequal length, or not divisible into `parts`, raise, and so
    do components of 2^26 or more after scaling.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code digit pair holds 256 entries at most")
    x = whole_numbers(F.col("embedding"), scale, bits=COMPONENT_BITS)
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", x.alias("x"))
    books = train(rows.select("vec_id", "x"), parts, entries, rounds)
    if books is None:
        books = np.zeros((parts, 1, 1), np.int64)
    codes = materialize(encode(rows, books))
    sums = codes.groupBy("label").agg(F.sum("error").cast(LongType()).alias("label_error"), F.count(F.lit(1)).alias("n_rows"))
    out = join_groups(codes, sums, "label", "n_rows")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
