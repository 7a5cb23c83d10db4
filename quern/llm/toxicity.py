"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic function of its hashed words; a document's is the noisy-or of its
sentences and a small leak. Training minimises the document log loss on a bounded sample of labelled texts,
so weight moves to the sentences that explain the labels. Words rarer than a few documents of the sample keep
no weight. Scoring reads whole texts, a bounded slice at a time, and locates the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, map_texts, materialize, slices, span_hashes, with_fields, word_bounds

#: Bound of the fitted sample: labelled texts of each class (chosen by a hash of the id).
PER_CLASS = 3000
#: Bytes of the sample's texts; those that do not fit are left out (see _within_bytes).
SAMPLE_BYTES = 64 << 20
#: Hashed word space, and sample documents that must hold a word.
BUCKETS = 1 << 20
MIN_DOCS = 5
#: Bytes of a word's beginning that are features of their own.
STEMS = (4, 5)
#: Weight of the absolute-value penalty that keeps the model to few words.
SPARSITY = 5e-5
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_MARK = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\"'()#*$%&|<>"])


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature bucket, sentence of each feature, document of each sentence, first byte and end byte of each sentence).

    The features of a word are the word and, where it is longer, its first bytes (for inflected words). A sentence
    ends after a word that ends in . ! or ?, at a line end and at the end of its text. Marks around a word are not
    part of it, A-Z are folded.
    """
    starts, ends = word_bounds(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    doc = np.searchsorted(offsets, starts, "right") - 1
    after = np.append(data, 10)[ends] == 10
    stop = _ENDS[data[ends - 1]] | after
    stop[:-1] |= doc[1:] != doc[:-1]
    stop[-1] = True
    sentence = np.concatenate([[0], np.cumsum(stop[:-1])])
    lead = np.concatenate([[True], stop[:-1]])
    lo, hi = starts.copy(), ends.copy()
    for _ in range(3):
        lo += _MARK[data[lo]] & (hi - lo > 1)
        hi -= _MARK[data[hi - 1]] & (hi - lo > 1)
    with np.errstate(over="ignore"):
        grams = [span_hashes(data, lo, hi)] + [span_hashes(data, lo, np.minimum(hi, lo + k)) for k in STEMS]
    use = np.stack([np.ones(len(lo), bool)] + [hi - lo > k for k in STEMS], axis=1)
    bucket = (np.stack(grams, axis=1)[use] >> np.uint64(44)).astype(np.int64)
    sentence = np.repeat(sentence, use.sum(axis=1))
    return bucket, sentence, doc[lead], starts[lead], ends[stop]


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    leak: float

    def sentence_logits(self, bucket: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(sentence, self.weight[bucket], n) + self.bias

    def documents(self, logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or of the sentences and the leak."""
        return 1 - (1 - self.leak) * np.exp(-np.bincount(doc, np.logaddexp(0, logits), n))


def train(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], labels: np.ndarray, share: float, epochs: int = 40, seed: int = 3) -> Model:
    """bags: for each document its word buckets, their sentence numbers, how often each is there, and the count of
    sentences.

    `share` is the share of label 1 among the labelled rows; the sample's classes are weighted back to it.
    """
    words, sent, times, doc, base = [], [], [], [], 0
    for k, (bucket, s, often, n) in enumerate(bags):
        words.append(bucket)
        times.append(often)
        sent.append(s + base)
        doc.append(np.full(n, k))
        base += n
    words, sent, times, doc = (np.concatenate(x) for x in (words, sent, times, doc))
    known, code = np.unique(words, return_inverse=True)
    w = np.zeros(len(known))
    bias, leak = -4.0, np.log(0.02 / 0.98)
    m = [np.zeros(len(known) + 2), np.zeros(len(known) + 2)]
    y = labels.astype(float)
    rate = y.mean()
    weight = np.where(y == 1, share / max(rate, 1e-9), (1 - share) / max(1 - rate, 1e-9))
    weight /= weight.sum()
    for t in range(1, epochs * 5 + 1):
        z = np.bincount(sent, w[code] * times, base) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        lk = 1 / (1 + np.exp(-leak))
        quiet = np.log1p(-lk) - np.bincount(doc, np.logaddexp(0, z), len(bags))  # log P(no toxic sentence)
        pd = np.clip(-np.expm1(quiet), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: (1 - y) p - y p (1 - pd) / pd
        up = np.where(y == 1, -(1 - pd) / pd, 1.0) * weight
        dz = up[doc] * p
        grad = np.concatenate([np.bincount(code, dz[sent] * times, len(known)) + SPARSITY * np.sign(w), [dz.sum(), (up * lk).sum()]])
        m[0] += 0.1 * (grad - m[0])
        m[1] += 0.01 * (grad * grad - m[1])
        step = 0.1 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-6)
        new = w - step[:-2]
        w = np.where(np.abs(new) < 1e-3, 0.0, new)
        bias, leak = bias - step[-2], float(np.clip(leak - step[-1], -7, -2))
    full = np.zeros(BUCKETS)
    full[known] = w
    return Model(full.astype(np.float32), float(bias), float(1 / (1 + np.exp(-leak))))


def _bagger(kept: np.ndarray | None):
    """doc_id, label, the distinct (bucket, sentence) pairs of the text and its number of sentences. With `kept`, a
    bit for each bucket, only pairs of those buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = None if kept is None else np.unpackbits(kept).astype(bool)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text"):
                bucket, sentence, doc, _, _ = sentences(data, offsets)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                if use is not None:
                    bucket, sentence = bucket[use[bucket]], sentence[use[bucket]]
                pair, times = np.unique(sentence * BUCKETS + bucket, return_counts=True)
                bucket, sentence = pair % BUCKETS, pair // BUCKETS
                edge = np.searchsorted(sentence, first)
                part = batch.slice(lo, hi - lo)
                at = pa.array(edge.astype(np.int32))
                relative = sentence - np.repeat(first[:-1], np.diff(edge))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (bucket, relative, times)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists, pa.array(np.diff(first).astype(np.int64))], ["doc_id", "label", "bucket", "sentence", "times", "n"])

    return run


_BAG = "doc_id long, label int, bucket array<int>, sentence array<int>, times array<int>, n long"


def _within_bytes(sized: DataFrame, most: int | None = None) -> DataFrame:
    """The rows (doc_id, label, size; two classes of PER_CLASS ids at most) whose texts are taken: half of the bytes go
    to each label. Texts of up to a sixteenth of that come first, in the order of a hash, then longer ones, the shortest
    first. A text that does not fit is left out; a label keeps one text at least."""
    most = (most or SAMPLE_BYTES) // 2
    is_long = F.col("size") > most // 16
    order = Window.partitionBy("label").orderBy(is_long, F.when(is_long, F.col("size")), F.xxhash64("doc_id", F.lit(5)), "doc_id")
    return sized.withColumn("taken", F.sum("size").over(order)).withColumn("nth", F.row_number().over(order)).where((F.col("taken") <= most) | (F.col("nth") == 1))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on documents (doc_id, text) and labels (doc_id, label 0 or 1), on PER_CLASS texts of each label and
    SAMPLE_BYTES of text (or one text of each label, if longer), chosen by a hash of the id. Null ids and labels are left
    out, as are ids that have both labels; repeated labels count once, as do rows of one id, whose text of least hash is
    taken. None where either class has no document; texts too long for the sample do not make a class empty.

    The words that MIN_DOCS of the sample's texts hold are counted before anything comes to the driver: it gets only
    pairs of such a word and a sentence.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("int")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    chosen = hash_sample(known, PER_CLASS, 5, "label")
    # a broadcast of at most 2 * PER_CLASS ids; of texts that share an id the one of least hash
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("mark", F.xxhash64("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sized = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("mark", size.alias("size"))).alias("one"))
    picked = F.broadcast(_within_bytes(sized.select("doc_id", "label", "one.*")).select("doc_id", "label", "mark"))
    picked = texts.join(picked, ["doc_id", "mark"]).groupBy("doc_id", "label").agg(F.first("text").alias("text"))
    picked = materialize(picked)
    held = picked.transform(map_texts, _bagger(None), _BAG).select(F.explode(F.array_distinct("bucket")).alias("bucket"))
    frequent = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS).select("bucket").toArrow()
    kept = np.zeros(BUCKETS, bool)
    kept[frequent["bucket"].to_numpy()] = True
    rows = picked.transform(map_texts, _bagger(np.packbits(kept)), _BAG).orderBy("doc_id").toArrow()
    if len(set(rows["label"].to_pylist())) < 2:
        return None
    columns = [rows[name] for name in ("bucket", "sentence", "times")]
    bags = [(*(np.array(x.values.to_numpy()) for x in lists), n) for *lists, n in zip(*columns, rows["n"].to_pylist(), strict=True)]
    return train(bags, rows["label"].to_numpy(), counts[1] / sum(counts.values()))


def _scorer(model: Model | None, locate: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text"):
                bucket, sentence, doc, start, end = sentences(data, offsets)
                n = hi - lo
                if model is None:
                    score, logits = np.full(n, 0.5), np.full(len(doc), -1.0)
                else:
                    logits = model.sentence_logits(bucket, sentence, len(doc))
                    score = model.documents(logits, doc, n)
                part = batch.slice(lo, n)
                out = [*(part.column(k) for k in range(part.num_columns)), pa.array(np.clip(score, 0, 1))]
                names = [*part.schema.names, "score"]
                if locate:
                    hit = np.flatnonzero(logits > 0)
                    at = np.searchsorted(doc[hit], np.arange(n + 1))
                    raw = data.tobytes()
                    text = pa.array([raw[start[k] : end[k]].decode() for k in hit], pa.string())
                    p = pa.array(1 / (1 + np.exp(-logits[hit])))
                    out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([text, p], ["sentence", "probability"])))
                    names.append("offending")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def score(docs: DataFrame, model: Model | None, locate: bool = True) -> DataFrame:
    """`docs` with `score` (0 to 1, the chance that the whole text is toxic) and, where `locate`, `offending`: its
    sentences more likely toxic than not, with their probabilities.

    A null or empty text has no sentence and scores the leak; without a model every score is 0.5. Every row is
    scored by itself: repeated rows, null ids and other columns pass through (columns of these names are replaced).
    """
    docs = docs.drop("score", "offending")
    more = {"offending": "array<struct<sentence:string,probability:double>>"} if locate else {}
    return docs.transform(map_texts, _scorer(model, locate), with_fields(docs, score="double", **more))
