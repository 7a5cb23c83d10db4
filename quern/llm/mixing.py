"""Mixing sources to target weights, block by block.

Each source's words, in the order of its documents, are cut into blocks of fixed length. The sources' shares
become block counts; every output shard draws its counts from the quotas (multinomial draws conditioned on the
totals, so that the targets are met), inside the task that needs them. The n-th slot of a source is mapped to a block by a
pseudorandom permutation of the source's block indices, pass after pass, and joined to the block by index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import map_texts, materialize, slices, word_bounds

#: Words in a block, and slots in an output shard.
BLOCK = 128
SHARD = 1 << 16
WEIGHTS = (3, 1, 2)
#: The mix's words against those of all sources, and the most passes over one source.
TOTAL = Fraction(3, 2)
PASSES = 2
#: Documents whose sizes are summed within one group when stream positions are given out.
GROUP = 512
#: Rounds of the block permutation.
ROUNDS = 16
#: Copies of one row that a task gives their places.
COPIES = 4096

def shares(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, total: Fraction = TOTAL, most: int = PASSES) -> dict[str | None, Fraction]:
    """Target words of each source: sources in code-point order (null last) weigh `weights` in turn and share
    `total` of all words; a target stops at `most` times its source and the excess is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = total * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not full:
            out |= {s: unit * weight[s] for s in free}
            break
        out |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


def _draw(rng: np.random.Generator, n: int, left: np.ndarray) -> np.ndarray:
    """`n` slots by a multinomial draw from the quotas `left`; what exceeds a quota is drawn again among the others."""
    got = np.zeros_like(left)
    while n:
        room = left - got
        draw = np.minimum(rng.multinomial(n, room / room.sum()), room)
        got, n = got + draw, n - int(draw.sum())
    return got


def shard_draws(quota: list[int], shards: Iterable[int], shard: int = SHARD, seed: int = 7) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source number, first slot of the source, slots) of some of the shards.

    The quotas are split by a binary tree over the shards: a node draws its left half's counts from its own, seeded
    by its place. So every task finds its shards' counts and first slots by a walk down the tree, they agree in any
    order and sum to the quotas in the end.
    """
    total = sum(quota)
    whole = (0, -(-total // shard), np.array(quota, np.int64), np.zeros(len(quota), np.int64))
    path = [whole]
    for s in shards:
        while not path[-1][0] <= s < path[-1][1]:
            path.pop()
        while path[-1][1] - path[-1][0] > 1:
            lo, hi, left, used = path[-1]
            mid = (lo + hi) // 2
            got = _draw(np.random.default_rng([seed, lo, hi]), (mid - lo) * shard, left)
            path.append((lo, mid, got, used) if s < mid else (mid, hi, left - got, used + got))
        _, _, got, used = path[-1]
        yield from ((s, k, int(used[k]), int(got[k])) for k in np.flatnonzero(got).tolist())


def _drawer(quota: list[int], blocks: list[int], seed: int):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = sorted(batch.column(0).to_pylist())
            rows = [(s, k, at, n, blocks[k]) for s, k, at, n in shard_draws(quota, shards, seed=seed)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], ["shard", "k", "first", "slots", "blocks"])

    return draw


def permuted(index: Column, n: Column, source: Column, pass_no: Column) -> Column:
    """A keyed permutation of 0..n-1 (swap or not: each round swaps x with its mirror image by a hashed bit)."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(source, pass_no, r) - x, n)
        swap = F.xxhash64(F.greatest(x, mirror), source, pass_no, r, F.lit(1)).bitwiseAND(F.lit(1))
        return F.when(swap == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), step)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text by its number of words."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch, "text"):
            starts, _ = word_bounds(data, offsets)
            size = np.diff(np.searchsorted(starts, offsets)).astype(np.int64)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(size)], ["doc_id", "source", "mark", "size"])


def _mark() -> Column:
    return F.xxhash64(F.col("text").cast("string"), F.col("source").cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), _mark().alias("mark"), F.col("text").cast("string"))


def _copy_numbers(rows: DataFrame) -> DataFrame:
    """Adds `copy`, from 0 among the rows of one doc_id and mark, to rows with their number in a scan: counted within
    each partition of the scan, behind the rows of the partitions before it, so no task sees all rows of a key."""
    rows = rows.withColumn("split", F.shiftright("number", 33))
    key = ["doc_id", "mark"]
    counts = rows.groupBy(*key, "split").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("split")) - F.col("n")
    counts = counts.select(*(F.col(c).alias(f"of_{c}") for c in [*key, "split"]), before.alias("before"))
    within = F.row_number().over(Window.partitionBy(*key, "split").orderBy("number")) - 1
    rows = rows.withColumn("within", within.cast("long"))
    same = F.lit(True)
    for c in [*key, "split"]:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return rows.join(counts, same).select("number", *key, (F.col("before") + F.col("within")).alias("copy"))


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each of the `copies` of a row, numbered from 0 (`copy`). What is repeated very often is cut into runs
    first, so that no task makes all copies of a row that is a large part of the table."""
    few = rows.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    many = rows.where(F.col("copies") > COPIES).withColumn("run", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
    many = many.repartition("k", "mark", "run").withColumn("copy", F.explode(F.expr(f"sequence(run, least(run + {COPIES}, copies) - 1)")))
    return few.unionByName(many.drop("run"))


def _positions(docs: DataFrame) -> DataFrame:
    """Adds `at`, the words of the source before the document: sums of hashed groups first, then within a group,
    so that a source of any size is spread over many groups. Needs doc_id, k (source number), mark and size;
    rows that agree in all of them are counted first and placed one behind the other, so they take no more than a row."""
    same = docs.columns
    docs = docs.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    groups = max(1, docs.agg(F.count(F.lit(1))).first()[0] // GROUP)
    docs = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "mark", F.lit(3)), F.lit(groups)))
    sums = docs.groupBy("k", "part").agg(F.sum("words").alias("words")).withColumn("row", F.floor(F.col("part") / GROUP))
    rows = sums.groupBy("k", "row").agg(F.sum("words").alias("words"))
    rows = rows.select("k", "row", (F.sum("words").over(Window.partitionBy("k").orderBy("row")) - F.col("words")).alias("row_at"))
    sums = sums.withColumn("part_at", F.sum("words").over(Window.partitionBy("k", "row").orderBy("part")) - F.col("words"))
    start = sums.join(rows, ["k", "row"]).select("k", "part", (F.col("row_at") + F.col("part_at")).alias("start"))
    within = Window.partitionBy("k", "part").orderBy("doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("before", F.sum("words").over(within) - F.col("words"))
    docs = docs.join(start, ["k", "part"]).withColumn("first_at", F.col("start") + F.col("before"))
    return _copies(docs).withColumn("at", F.col("first_at") + F.col("copy") * F.col("size")).select(*same, "copy", "at")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix of `docs` (doc_id, text, source): a table of its documents and a table of its spans.

    Documents: doc_id, source, mark, size (words), k (number of the source), source_size, target, copy, at (words
    of the source before it) - one row per row of `docs`. Spans: shard, slot, k, at, start, length - the words of
    each slot of each output shard, by document. `copy` numbers the rows of one doc_id, text and source from 0. A null or empty text has no words and no span; null is a source
    of its own, the last; a null doc_id comes first in its group; repeated rows are interchangeable and each keep
    their place. An empty table gives empty tables. The number of sources is a configuration's: their sizes are
    read on the driver, documents are not.
    """
    spark = docs.sparkSession
    sized = materialize(_keyed(docs).transform(map_texts, _counter, "doc_id long, source string, mark long, size long"))
    sizes = {r["source"]: r["words"] for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    target = shares(sizes, weights) if sizes else {}
    order = list(target)
    order.sort(key=lambda s: (s is None, s or ""))
    blocks = [-(-sizes[s] // BLOCK) for s in order]
    quota = [min(PASSES * n, round(target[s] * n / sizes[s])) if n else 0 for s, n in zip(order, blocks, strict=True)]
    dim = spark.createDataFrame([(s, k, sizes[s], float(target[s])) for k, s in enumerate(order)], "name string, k int, source_size long, target double")
    numbered = sized.join(F.broadcast(dim), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = materialize(_positions(numbered))
    n_shards = -(-sum(quota) // SHARD)
    draws = spark.range(n_shards).mapInArrow(_drawer(quota, blocks, seed), "shard long, k int, first long, slots long, blocks long")
    slot = draws.select("shard", "k", "blocks", F.explode(F.expr("sequence(first, first + slots - 1)")).alias("slot"))
    slot = slot.select("shard", "slot", "k", permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.col("k"), F.floor(F.col("slot") / F.col("blocks"))).alias("block"))
    held = placed.where("size > 0").select("k", "at", "size", F.explode(F.expr(f"sequence(at div {BLOCK}, (at + size - 1) div {BLOCK})")).alias("block"))
    lo, hi = F.greatest("at", F.col("block") * BLOCK), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK)
    held = held.select("k", "block", "at", (lo - F.col("at")).alias("start"), (hi - lo).alias("length"))
    # always by shuffle: slots grow with the corpus, and their size is not known from the range they come from
    return placed, slot.hint("merge").join(held, ["k", "block"]).select("shard", "slot", "k", "at", "start", "length")


@F.pandas_udf(StringType())
def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, items in zip(text, spans, strict=True):
        raw = t.encode()
        starts, ends = word_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        out.append("\n".join(raw[starts[s["start"]] : ends[s["start"] + s["length"] - 1]].decode() for s in items))
    return pd.Series(out, dtype=object)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix as documents: the columns of `docs`, each document's text being the words that the mix takes of
    it (pass by pass, a line per span) and n_chars, where there is such a column, their length. A document of
    which nothing is taken is not in the mix. Edge cases are those of `mix`. `docs` is scanned three times and must
    give its rows in the same partitions and order each time, as tables and files do.
    """
    placed, spans = mix(docs, weights)
    taken = spans.groupBy("k", "at").agg(F.array_sort(F.collect_list(F.struct("slot", "start", "length"))).alias("spans"))
    own = ["doc_id", "mark", "copy"]
    taken = placed.where("size > 0").join(taken, ["k", "at"]).select(*(F.col(c).alias(f"own_{c}") for c in [*own, "spans"]))
    same = F.lit(True)
    for c in own:
        same &= F.col(c).eqNullSafe(F.col(f"own_{c}"))
    # rows by their number in the scan: numbers and keys alone say which copy a row is, its text is dealt once
    row = F.struct("*").alias("row")
    numbered = docs.select(row, F.col("doc_id").cast("long"), _mark().alias("mark"), F.monotonically_increasing_id().alias("number"))
    chosen = _copy_numbers(numbered.select("number", "doc_id", "mark")).join(taken, same).select("number", "own_spans")
    out = numbered.select("row", "number").join(chosen.hint("merge"), "number")
    out = out.select("row", _cut(F.col("row.text"), F.col("own_spans")).alias("own_text"))
    edited = {"text": F.col("own_text"), "n_chars": F.length("own_text").cast("long")}
    return out.select(*(edited.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
