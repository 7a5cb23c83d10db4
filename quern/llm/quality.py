"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text are bounded samples of feature rows; the share of positives in the
unlabelled text (the class prior) is estimated by the best-bin rule from a first positive-against-unlabelled
model; then the model is fitted to the non-negative unbiased risk. Features are counts over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_texts, slices, with_fields, words

#: Bounds of the fitted samples: trusted positives and unlabelled texts (chosen by a hash of the id).
POSITIVES = 6000
UNLABELLED = 12000

_SHAPES = 10
N_FEATURES = 128 + 4 + _SHAPES


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: square roots of byte shares (bytes from 128 on in four classes), then shape counts."""
    n = len(offsets) - 1
    x = np.zeros((n, N_FEATURES), np.float32)
    h, first = words(data, offsets, fold=True)
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        w = h[first[i] : first[i + 1]]
        size, k = b - a, len(w)
        if not k:
            x[i, -1] = 1
            continue
        count = np.bincount(data[a:b], minlength=256)
        x[i, :128] = np.sqrt(count[:128] / size)
        x[i, 128:132] = np.sqrt(count[128:].reshape(4, 32).sum(axis=1) / size)
        ink, ups = int(count[33:].sum()), int(count[65:91].sum())
        lets = ups + int(count[97:123].sum() + count[128:].sum())
        kinds = len(np.unique(w))
        pairs = w[:-1] * np.uint64(3) + w[1:]
        repeats = 1 - len(np.unique(pairs)) / max(1, len(pairs))
        x[i, 132:] = (np.log1p(k) / 8, ink / k / 10, ups / max(1, lets), lets / max(1, ink), kinds / k, repeats, float(k < 10), float(k < 30), count[10] / k, 0.0)
    return x


def _featurizer(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text"):
                with np.errstate(over="ignore"):
                    x = features(data, offsets)
                part = batch.slice(lo, hi - lo)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(columns))), flat], [*columns, "x"])

    return run


@dataclass
class Model:
    """One hidden layer of rectified units over standardised features; `score` is the probability of a positive."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(pos: np.ndarray, web: np.ndarray, prior: float | None, hidden: int = 16, epochs: int = 12, seed: int = 5) -> Model:
    """With a prior: non-negative positive-unlabelled risk of the logistic loss. Without: positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, web])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 0.02
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (pos, web))
    d = p.shape[1]
    theta = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    moment, square, t = [np.zeros_like(v) for v in theta], [np.zeros_like(v) for v in theta], 0
    size = 256
    steps = max(1, max(len(p), len(u)) // size)
    for _ in range(epochs):
        for _ in range(steps):
            xp, xu = p[rng.integers(0, len(p), size)], u[rng.integers(0, len(u), size)]
            x = np.concatenate([xp, xu])
            a = x @ theta[0] + theta[1]
            r = np.maximum(a, 0)
            g = r @ theta[2] + theta[3][0]
            gp, gu = g[:size], g[size:]
            if prior is None:
                dg = np.concatenate([-_sigmoid(-gp) / size, _sigmoid(gu) / size])
            else:
                negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                part = np.concatenate([-prior * _sigmoid(gp) / size, _sigmoid(gu) / size])
                dg = np.concatenate([-prior * _sigmoid(-gp) / size, np.zeros(size)]) + part if negative >= 0 else -part
            back = np.outer(dg, theta[2]) * (a > 0)
            grad = [x.T @ back + 1e-4 * theta[0], back.sum(axis=0), r.T @ dg + 1e-4 * theta[2], np.array([dg.sum()])]
            t += 1
            for v, m, s, gr in zip(theta, moment, square, grad, strict=True):
                m += 0.1 * (gr - m)
                s += 0.001 * (gr * gr - s)
                v -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, *theta[:3], float(theta[3][0]), prior if prior is not None else float("nan"))


def estimate_prior(pos: np.ndarray, web: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate: over thresholds of a positive-against-unlabelled score held out from its fit, the least
    ratio of the unlabelled share above to the positive share above. The unlabelled share enters by its lower
    confidence bound: an overestimated prior would teach the model to take negatives for positives."""
    model = _fit(pos[::2], web[::2], None)
    p, q = np.sort(model.margin(pos[1::2])), np.sort(model.margin(web[1::2]))
    slack = np.sqrt(np.log(4 / delta) / 2 / len(p)) + np.sqrt(np.log(4 / delta) / 2 / len(q))
    at = np.unique(np.concatenate([p, q]))
    above_p = 1 - np.searchsorted(p, at) / len(p)
    above_q = 1 - np.searchsorted(q, at) / len(q)
    usable = above_p > 0.05
    best = np.argmin((above_q[usable] + slack) / above_p[usable])
    bound = np.sqrt(np.log(4 / delta) / 2 / len(q))
    return float(np.clip((above_q[usable][best] - bound) / above_p[usable][best], 0.02, 0.98))


def fit(docs: DataFrame, trusted: DataFrame) -> Model | None:
    """Fits on documents (doc_id, text): those whose id is in `trusted` (doc_id) are positives, all are unlabelled
    web text. Both samples are bounded (POSITIVES, UNLABELLED) and chosen by a hash of the id; of rows that share an id
    the text of least hash counts. None where there is no positive to learn from.
    """
    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    ids = trusted.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    chosen = hash_sample(ids, POSITIVES, 11).withColumn("positive", F.lit(True))
    web_ids = hash_sample(some.select("doc_id"), UNLABELLED, 11).withColumn("positive", F.lit(False))
    # a broadcast of at most POSITIVES + UNLABELLED ids
    picked = some.join(F.broadcast(chosen.unionByName(web_ids)), "doc_id")
    # of rows that share an id one text, so that what comes to the driver is bounded by the ids
    picked = picked.groupBy("doc_id", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    schema = "doc_id long, positive boolean, x array<float>"
    rows = picked.select("doc_id", "positive", "text").transform(map_texts, _featurizer(["doc_id", "positive"]), schema).orderBy("doc_id", "positive").toArrow()
    if not rows.num_rows:
        return None
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)
    positive = rows["positive"].to_numpy()
    pos, web = x[positive], x[~positive]
    if len(pos) < 2 or len(web) < 2:
        return None
    return _fit(pos, web, estimate_prior(pos, web))


def _scorer(model: Model | None, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text"):
                with np.errstate(over="ignore"):
                    s = model.score(features(data, offsets)) if model else np.full(hi - lo, 0.5)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(part.num_columns)), pa.array(s)], [*part.schema.names, name])

    return run


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """`docs` with a column `name`: the probability (0 to 1) that the whole text is of the positive class.

    A null or empty text is scored by its own features (no words); without a model every score is 0.5. Rows are
    kept as they are: repeated rows, null ids and other columns pass through (a column already called `name`
    is replaced).
    """
    docs = docs.drop(name)
    return docs.transform(map_texts, _scorer(model, name), with_fields(docs, **{name: "double"}))
