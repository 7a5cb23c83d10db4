"""Whitening of embeddings: moments by Welford's rank-one updates, merged over partitions, and symmetric QR.

Every partition streams its rows through one running mean and one matrix of centred products; the states of the
partitions are merged by the parallel update formula in two rounds of tasks. Only one state, whose size is the
square of the dimension, reaches the driver; its eigenvectors are sent back in the closure of a projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Tasks of the first round of merging; the second is one task that reads as many states.
MERGERS = 32
STATE = "part int, n long, total array<long>, mean array<double>, products array<double>"
KINDS = {"long": np.int64, "double": np.float64}


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and all its components are finite."""
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & real, F.lit(False))


def whole_numbers(vector: Column, scale: int, offset: int = 0, bits: int = 52) -> Column:
    """floor(scale * component) + offset; a scaled component of `bits` bits or more raises."""
    far = F.raise_error(F.lit(f"a component times {scale} needs {bits} bits or more"))
    scaled = lambda x: F.lit(scale) * x.cast("double")
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < 2.0**bits, F.floor(scaled(x)) + offset).otherwise(far).cast("long"))


def matrix(batch: pa.RecordBatch, column: str, kind: str = "long") -> np.ndarray:
    """The list column as a matrix; lists of unequal length raise ValueError."""
    col = batch.column(batch.schema.get_field_index(column))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(KINDS[kind], copy=False)
    widths = np.diff(col.offsets.to_numpy())
    if len(widths) and (widths != widths[0]).any():
        raise ValueError("vectors of unequal length")
    return flat.reshape(len(col), -1)


@dataclass
class Moments:
    """Rows, exact sums of whole numbers, mean and sums of centred products."""

    n: int
    total: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Moments:
        return cls(0, np.zeros(width, np.int64), np.zeros(width), np.zeros((width, width)))

    def add(self, row: np.ndarray) -> None:
        """Welford's update: one row moves the mean, and adds a matrix of rank one to the products."""
        if len(row) != len(self.mean):
            raise ValueError("vectors of unequal length")
        self.n += 1
        step = row - self.mean
        self.mean += step / self.n
        self.products += np.multiply.outer(step * ((self.n - 1) / self.n), step)

    def merge(self, other: Moments) -> None:
        """The parallel update: both states as if their rows had met in one."""
        if len(other.mean) != len(self.mean):
            raise ValueError("vectors of unequal length")
        n, step = self.n + other.n, other.mean - self.mean
        self.products += other.products + np.multiply.outer(step * (self.n * (other.n / n)), step)
        self.mean += step * (other.n / n)
        self.total += other.total
        self.n = n

    def batch(self, part: int) -> pa.RecordBatch:
        names, kinds = ["part", "n", "total", "mean", "products"], [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        values = [part, self.n, self.total, self.mean, self.products.reshape(-1)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def _streamed(kind: str):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch, "x", kind)
            if state is None:
                state, part = Moments.empty(rows.shape[1]), batch.column(1)[0].as_py()
            if kind == "long":
                state.total += rows.sum(axis=0)
            for row in rows:
                state.add(row)
        if state is not None:
            yield state.batch(part)

    return stream


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, part = None, 0
    for batch in batches:
        for row in batch.to_pylist():
            width = len(row["mean"])
            one = Moments(row["n"], np.array(row["total"], np.int64), np.array(row["mean"]), np.array(row["products"]).reshape(width, width))
            if state is None:
                state, part = one, row["part"]
            else:
                state.merge(one)
    if state is not None:
        yield state.batch(part)


def moments(rows: DataFrame, kind: str = "long") -> Moments | None:
    """Moments of column x (array<long>, or array<double> whose total stays zero); None where there are no rows.

    The states of all partitions are merged in the order of their partitions, so reruns over the same partitions
    agree to the last bit.
    """
    states = rows.select("x", F.spark_partition_id().alias("part")).transform(map_texts, _streamed(kind), STATE)
    some = states.repartition(MERGERS, "part").sortWithinPartitions("part").transform(map_texts, _merged, STATE)
    one = some.repartition(1).sortWithinPartitions("part").transform(map_texts, _merged, STATE).collect()
    if not one:
        return None
    r = one[0]
    width = len(r.mean)
    return Moments(r.n, np.array(r.total, np.int64), np.array(r.mean), np.array(r.products).reshape(width, width))


# ---------------------------------------------------------------------------------------------
# eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and q (as rows) of the tridiagonal form q a q', by reflections."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        head = -np.copysign(length, v[0])
        v[0] -= head
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - v * (v @ p))
        a[k + 1 :, k + 1 :] -= np.multiply.outer(v, w) + np.multiply.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = head
        q[k + 1 :] -= np.multiply.outer(2 * v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest down, and unit eigenvectors as rows, each with its largest entry positive.

    Implicit QR steps with Wilkinson's shift on the tridiagonal form, block by block from the lower end.
    """
    d, e, q = tridiagonal(a)
    eps = np.finfo(float).eps
    floor = eps * eps * max(np.abs(d).max(initial=0), np.abs(e).max(initial=0))
    hi = len(d) - 1
    while hi > 0:
        e[np.abs(e) <= np.maximum(eps * (np.abs(d[:-1]) + np.abs(d[1:])) / 4, floor)] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a0, a1, b = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * a0 + 2 * c * s * b + s * s * a1, s * s * a0 - 2 * c * s * b + c * c * a1
            e[k] = (c * c - s * s) * b + c * s * (a1 - a0)
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    d, q = d[order], q[order]
    signs = np.sign(q[np.arange(len(q)), np.abs(q).argmax(axis=1)])
    return d, q * signs[:, None]


# ---------------------------------------------------------------------------------------------
# the operator


@dataclass
class Whitening:
    n: int
    total: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact squared lengths of n * x - total (OverflowError beyond a long), and whitened rows."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        reach = self.n * most + int(np.abs(self.total).max(initial=0))
        if reach * reach * x.shape[1] < 2**63:
            away = self.n * x - self.total
            squares = (away * away).sum(axis=1)
        else:
            wide = x.astype(object) * self.n - self.total.astype(object)
            squares = (wide * wide).sum(axis=1)
            if max(squares, default=0) >= 2**63:
                raise OverflowError("a squared deviation does not fit a long")
            away, squares = wide.astype(np.float64), squares.astype(np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return squares, (away / self.n) @ self.vectors.T / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of column x (array<long>) by its leading components; None where there are no rows.

    An eigenvalue that rounding alone can make (all rows alike, or fewer rows than components) counts as zero.
    """
    state = moments(rows)
    if state is None:
        return None
    values, vectors = symmetric_qr(state.products / state.n)
    trace = float(np.trace(state.products) / state.n)
    noise = len(values) * np.finfo(float).eps * max(values[0], 0)
    values = np.where(values > noise, values, 0)[:components]
    model = Whitening(state.n, state.total, values, vectors[:components], trace)
    live = int((values > 0).sum())
    if live:
        check = moments(rows.select("x").transform(map_texts, _projector(model, live), "x array<double>"), "double")
        model.identity_error = float(np.abs(check.products / check.n - np.eye(live)).max())
    return model


def _projector(model: Whitening, live: int):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                white = np.ascontiguousarray(model.project(matrix(batch, "x"))[1][:, :live])
                offsets = pa.array(np.arange(0, white.size + 1, live, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(white.reshape(-1)))], names=["x"])

    return project


def _whitener(model: Whitening):
    k = len(model.values)
    share = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            squares, white = model.project(matrix(batch, "x"))
            flat = pa.array(white.reshape(-1), mask=np.tile(model.values <= 0, n))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.n)),
                    pa.array(np.repeat(squares, k)),
                    flat,
                    pa.array(np.tile(share, n)),
                    pa.array([model.identity_error] * (n * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return whiten


def whitened(vectors: DataFrame, scale: int = 1024, offset: int = 100_000, components: int = 8) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding) and leading component: vec_id, component (from 1), n,
    deviation, whitened, explained, identity_error.

    A component c of a vector counts as floor(scale * c) + offset. Vectors that are null or empty or hold a null or
    a component that is not finite take no part. Repeated rows count as often as they occur and come back as often;
    a null vec_id stays; other columns are ignored. Vectors of fewer dimensions than `components` give one row for
    each dimension. Where an eigenvalue is zero, `whitened` is null and `explained` zero; identity_error is over the
    others, null without any. An empty table gives no rows. Vectors of unequal length raise, as do components of
    2^52 or more after scaling and deviations beyond a long.
    """
    x = whole_numbers(F.col("embedding"), scale, offset)
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", x.alias("x"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.transform(map_texts, _whitener(model), schema)
