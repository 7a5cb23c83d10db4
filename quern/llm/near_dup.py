"""MinHash near-duplicate detection with tensored banding, confirmed on full shingle sets.

A table key joins one band of a first hash collection with one band of a second: m + m bands give m * m
tables, so a text needs 2 * m * rows minhashes instead of m * m * 2 * rows. Steps:

1. one pass over the texts: set size, 128-bit set fingerprint, the 2 * m bands;
2. texts with equal sets collapse to their smallest id (partial aggregation, so copies never meet);
3. bands that occur once cannot make a table hit: only the rest are combined to table keys;
4. every key points its members to its smallest member (linear, no pairs); the components of these
   pointers hold every candidate pair;
5. members are verified in work units of bounded size: a large component is cut by set size and hash,
   and only units whose set sizes can reach the similarity meet. A unit returns a spanning forest of
   its confirmed links, never its pairs;
6. the components of the confirmed links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, mix, shingles, slices, words

#: Texts of one side of a work unit, and the shingles that they hold together, about (a longer text is a side of its own).
UNIT = 256
UNIT_SHINGLES = 1 << 22
#: Cells of the grid in which a unit's sets are compared, so many texts of it at a time.
GRID = 1 << 26
#: Minhashes in a band; two bands make a table key.
ROWS = 4
#: Chance that a pair exactly at the threshold meets in no table.
MISS = 1e-4


def collections(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands in each of the two collections so that a pair at the threshold is missed with chance `miss` at most."""
    hit = threshold**rows
    return max(2, math.ceil(math.log(miss / 2) / math.log(1 - hit)))


def _sketcher(width: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240607)
        n_hash = 2 * bands * rows
        mul = (rng.integers(0, 1 << 32, n_hash, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
        add = rng.integers(0, 1 << 32, n_hash, dtype=np.uint64).astype(np.uint32)[:, None]
        salt = mix(np.arange(1, 2 * bands + 1, dtype=np.uint64))
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in slices(batch, "text"):
                with np.errstate(over="ignore"):
                    h, first = words(data, offsets)
                    k = hi - lo
                    sizes = np.zeros(k, np.int64)
                    prints = np.zeros((k, 2), np.uint64)
                    mins = np.zeros((k, n_hash), np.uint32)
                    for i in range(k):
                        s = np.unique(shingles(h[first[i] : first[i + 1]], width))
                        if not len(s):
                            continue
                        sizes[i] = len(s)
                        prints[i, 0] = s.sum(dtype=np.uint64)
                        prints[i, 1] = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                        low = (s >> np.uint64(32)).astype(np.uint32)
                        for p in range(0, len(low), 4096):
                            part = ((low[p : p + 4096] ^ add) * mul).min(axis=1)
                            mins[i] = part if p == 0 else np.minimum(mins[i], part)
                    acc = np.broadcast_to(salt, (k, 2 * bands)).copy()
                    grouped = mins.reshape(k, 2 * bands, rows).astype(np.uint64)
                    for r in range(rows):
                        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
                flat = acc.view(np.int64).reshape(-1)
                side = pa.array(np.arange(0, k * 2 * bands + 1, 2 * bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, k), pa.array(sizes), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)), pa.ListArray.from_arrays(side, pa.array(flat))],
                    ["doc_id", "n_shingles", "print_a", "print_b", "bands"],
                )

    return sketch


def sketches(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, two fingerprint halves, and the bands of both collections, for every row of `docs`."""
    bands = collections(threshold)
    schema = "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_texts, _sketcher(width, bands, ROWS), schema)


def components(edges: DataFrame, rows: int | None = None, rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest node reachable, by alternating large and small stars.

    `edges` has columns a, b; `rows` estimates them. Every step keeps minima and joins them back, so a node with very
    many neighbours is pre-aggregated and never gathered; it ends when every node points to a root, and raises where
    that takes more than `rounds` (they grow with the logarithm of the longest path). Nulls and self links are left
    out, repeated links count once, no edges give no rows. Nodes without an edge are not returned.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), rows)
    for round_no in range(rounds + 1):
        ends = now.select("a", F.lit(1).alias("out"), F.lit(0).alias("into"))
        ends = ends.unionByName(now.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        ends = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        is_open = (F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))
        n, open_nodes = ends.agg(F.sum("out"), F.count(F.when(is_open, 1))).first()
        if not open_nodes:
            break
        if round_no == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        both_ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(both_ends).alias("e")).select("e.*").where("a <> b").distinct()
        now = materialize(small, n)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _pointers(reps: DataFrame, bands: int, n: int) -> DataFrame:
    """(a, b): each member of a table key and the key's smallest member."""
    side = lambda lo, name: reps.select("rep", F.lit(name).alias("side"), F.explode(F.slice("bands", lo, bands)).alias("band"))
    rows = side(1, 0).unionByName(side(bands + 1, 1))
    shared = rows.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("band")
    live = rows.join(shared, "band", "left_semi")
    of = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("band")))
    halves = live.groupBy("rep").agg(of(0).alias("first"), of(1).alias("second"))
    halves = materialize(halves.where((F.size("first") > 0) & (F.size("second") > 0)), n)
    pairs = halves.select("rep", "second", F.explode("first").alias("x")).select("rep", "x", F.explode("second").alias("y"))
    keys = pairs.select("rep", F.xxhash64("x", "y").alias("key"))
    heads = keys.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last"))
    heads = heads.where("head < last").select("key", "head")
    return keys.join(heads, "key").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()


def _set_maker(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text"):
                with np.errstate(over="ignore"):
                    h, first = words(data, offsets)
                    sets = [np.unique(shingles(h[first[i] : first[i + 1]], width)) for i in range(hi - lo)]
                    sums = pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), sums, pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "units", "print_a", "found", "shingle_set"])

    return make


def _forest(ids: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links of one unit: pairs across sides 0 and 1, or all pairs where every side is -1."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    held = np.array_split(codes, ends[:-1])
    width = int(codes.max()) + 1
    left = [i for i, s in enumerate(sides) if s < 1]
    right = [i for i, s in enumerate(sides) if s != 0]
    out = []
    step = max(1, min(64, GRID // width))
    for p in range(0, len(left), step):
        rows = left[p : p + step]
        counts = np.zeros((len(rows), len(right)), np.int64)
        grid = np.zeros((len(rows), width), bool)
        for k, i in enumerate(rows):
            grid[k, held[i]] = True
        for k, j in enumerate(right):
            counts[:, k] = np.count_nonzero(grid[:, held[j]], axis=1)
        union = sizes[rows][:, None] + sizes[right][None, :] - counts
        for k, j in np.argwhere(100 * counts >= percent * union):
            a, b = rows[k], right[j]
            if a != b and find(a) != find(b):
                root[find(a)] = find(b)
                out.append((ids[a], ids[b]))
    return out


def _verifier(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, sides, sets, found = None, [], [], [], []

        def close():
            if len(ids) > 1:
                found.extend(e for e in _forest(ids, sides, sets, percent) if e[0] != e[1])

        for batch in batches:
            for at, (u, i, side) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True)):
                if u != unit:
                    close()
                    unit, ids, sides, sets = u, [], [], []
                ids.append(i)
                sides.append(side)
                sets.append(np.frombuffer(batch.column(3)[at].as_py(), np.uint64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])
                found = []
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return verify


def _units(members: DataFrame, threshold: float, n: int) -> DataFrame:
    """Adds to (rep, n_shingles, cluster) an array of (unit, side): bounded groups that together hold every pair that sizes allow."""
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(1 / threshold)).cast("int")
    m = materialize(members.withColumn("band", band), n)
    # how many sides rows fill: by their number, or by their shingles where those are more
    sides = F.ceil(F.greatest(F.count(F.lit(1)) / UNIT, F.sum("n_shingles") / UNIT_SHINGLES)).cast("int")
    total = m.groupBy("cluster").agg(sides.alias("total"))
    parts = m.groupBy("cluster", "band").agg(sides.alias("parts"))
    near = lambda d, name: parts.select("cluster", (F.col("band") + d).alias("band"), F.col("parts").alias(name))
    m = m.join(total, "cluster").join(parts, ["cluster", "band"]).join(near(-1, "above"), ["cluster", "band"], "left").join(near(1, "below"), ["cluster", "band"], "left").fillna(0, ["above", "below"])
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int")
    m = m.withColumn("own", own)
    unit = lambda kind, at, x, y: F.xxhash64("cluster", F.lit(kind), at, x, y)
    item = lambda key, side: F.struct(key.alias("unit"), side.cast("int").alias("side"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(upto("parts"), lambda t: item(unit(1, F.col("band"), F.least("own", t), F.greatest("own", t)), F.when(t == F.col("own"), -1).when(F.col("own") < t, 0).otherwise(1)))
    up = F.transform(upto("above"), lambda t: item(unit(2, F.col("band"), F.col("own"), t), F.lit(0)))
    down = F.transform(upto("below"), lambda t: item(unit(2, F.col("band") - 1, t, F.col("own")), F.lit(1)))
    whole = F.array(item(unit(0, F.lit(0), F.lit(0), F.lit(0)), F.lit(-1)))
    return m.select("rep", "print_a", "print_b", F.when(F.col("total") == 1, whole).otherwise(F.concat(same, up, down)).alias("units"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked where 100 * |A & B| >= percent * |A | B| for their sets A, B of `width`-word
    shingles (words are runs of bytes other than ASCII white space, A-Z folded); component_id is the
    smallest doc_id reachable over links, kept is doc_id = component_id. A text with fewer words is one
    shingle; a null, empty or blank text has an empty set and is its own component. A null doc_id takes no
    part: component_id is null and the row is kept. Repeated rows collapse like any copies; rows that share
    an id but not a text are compared like different documents. Other columns are ignored.
    """
    threshold = percent / 100
    base = materialize(sketches(docs, width, threshold))
    usable = base.where("n_shingles > 0 and doc_id is not null")
    prints = ["print_a", "print_b", "n_shingles"]
    reps = usable.groupBy(*prints).agg(F.min(F.struct("doc_id", "bands")).alias("one"))
    reps = reps.select(*prints, F.col("one.doc_id").alias("rep"), F.col("one.bands").alias("bands"))
    reps = materialize(reps, base.count())
    n = reps.count()
    clusters = components(_pointers(reps, collections(threshold), n), n)
    clusters = clusters.select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    members = reps.select("rep", *prints).join(clusters, "rep")
    units = materialize(_units(members, threshold, n), n)
    # always by shuffle: the members grow with the corpus, and a plan that flips to broadcast hides it
    whole = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string"))
    texts = units.hint("merge").join(whole, "rep").select("rep", "units", "print_a", "text")
    kind = "rep long, units array<struct<unit:long,side:int>>, print_a long, found long, shingle_set binary"
    sets = texts.transform(map_texts, _set_maker(width), kind)
    sets = sets.where("print_a = found")  # another text under the same id is another class
    dealt = sets.select("rep", "shingle_set", F.explode("units").alias("u"))
    dealt = dealt.select("u.unit", "rep", "u.side", "shingle_set")
    links = dealt.repartition("unit").sortWithinPartitions("unit").transform(map_texts, _verifier(percent), "a long, b long")
    roots = components(links)
    classes = reps.select(*prints, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*prints, F.coalesce("root", "rep").alias("class_root"))
    # blank rows belong to no class: they would all meet in one key of the join
    wordless = base.where("n_shingles = 0")
    out = base.where("n_shingles > 0").join(classes, prints, "left").unionByName(wordless, allowMissingColumns=True)
    component = F.when(F.col("n_shingles") > 0, F.coalesce("class_root", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group of near duplicates, the one of the smallest doc_id; edge cases are
    those of near_duplicates. Rows without an id stay; a row repeated with its id and text stays once.
    """
    ids = near_duplicates(docs, width, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("kept_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    once = row.join(ids.hint("merge"), "kept_id", "left_semi").dropDuplicates(["kept_id", "mark"])
    return once.unionByName(row.where("kept_id is null")).select("row.*")
