"""Language identification as inference of a multilingual mixture.

A word's likelihood in a language is the product of its byte-trigram likelihoods. A text is a mixture of
languages over its words: expectation-maximisation estimates the proportions, for the best one, two, ...
languages in turn, and the set of languages is chosen by penalised likelihood. The prediction is the language
with the largest proportion in the chosen set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_texts, slices, with_fields, word_bounds

#: Bound of the fitted sample: labelled texts of each language (chosen by a hash of the id).
PER_LANGUAGE = 1500
GRAMS = 1 << 16
SMOOTH = 0.2
ROUNDS = 6
#: Log-likelihood that a further language must gain, times the log of the number of words. Trigrams of a word
#: overlap, so their likelihoods are overconfident; a penalty above one half allows for that.
PENALTY = 3.0
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.int32)
_LOWER[65:91] += 32


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of the words, one for each byte (with the two before it, a blank before the word), and the
    index of each word's first."""
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))
    c = _LOWER[data[at]]
    one, two = np.empty_like(c), np.empty_like(c)
    one[1:], two[2:] = c[:-1], c[:-2]
    one[first] = 32
    two[first] = 32
    second = (first + 1)[sizes > 1]
    two[second] = 32
    return (two * 40503 ^ one * 12289 ^ c * 769) & (GRAMS - 1), first


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # GRAMS x languages, log likelihoods


def mixture(ll: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) in the language set of best penalised likelihood.

    ll: words x languages; first: the first word of each text (texts without a word must not occur); n: words.
    """
    sizes = np.diff(np.append(first, n))
    text = np.repeat(np.arange(len(first)), sizes)
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(ll - top)
    base = np.add.reduceat(top[:, 0], first)
    single = np.add.reduceat(ll, first, axis=0)
    k = ll.shape[1]
    best = np.eye(k)[single.argmax(axis=1)]
    value = single.max(axis=1)

    def run(weight: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            joint = like * weight[text]
            joint /= joint.sum(axis=1, keepdims=True) + 1e-300
            weight = np.add.reduceat(joint, first, axis=0) / sizes[:, None]
        return weight, np.add.reduceat(np.log((like * weight[text]).sum(axis=1) + 1e-300), first) + base

    if k > 1:
        full, _ = run(np.full((len(first), k), 1 / k), ROUNDS)
        order = np.argsort(-full, axis=1, kind="stable")
        for m in range(2, k + 1):
            allowed = np.zeros_like(full)
            np.put_along_axis(allowed, order[:, :m], 1, axis=1)
            start = (full + 1e-3) * allowed
            weight, got = run(start / start.sum(axis=1, keepdims=True), ROUNDS // 2)
            got = got - PENALTY * (m - 1) * np.log(sizes + 1)
            better = got > value
            best[better], value[better] = weight[better], got[better]
    return best, value


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, summed over each slice."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch, "text"):
            langs = np.array(batch.column(0).slice(lo, hi - lo).to_pylist(), object)
            starts, ends = word_bounds(data, offsets)
            if not len(starts):
                continue
            gram, first = _grams(data, starts, ends)
            of = langs[np.searchsorted(offsets, starts, "right") - 1][np.searchsorted(first, np.arange(len(gram)), "right") - 1]
            for lang in set(of.tolist()):
                count = np.bincount(gram[of == lang], minlength=GRAMS)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(count[some].astype(np.int64))], ["lang", "gram", "n"])


def fit(docs: DataFrame) -> Model | None:
    """Fits on documents (doc_id, text, lang), on PER_LANGUAGE texts of each language at most. Null ids and
    languages are left out; None where nothing is left. The sample's ids and the table of trigram counts
    (65536 rows a language) are bounded whatever the corpus."""
    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("doc_id is not null and lang is not null and text is not null")
    ids = hash_sample(some.select("doc_id", "lang"), PER_LANGUAGE, 9, "lang").select("doc_id", F.col("lang").alias("of")).distinct()
    picked = some.join(F.broadcast(ids), (some["doc_id"] == ids["doc_id"]) & (F.col("lang") == F.col("of")))
    rows = picked.select("lang", "text").transform(map_texts, _counter, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return None
    langs = sorted(set(rows["lang"].to_pylist()))
    count = np.full((GRAMS, len(langs)), SMOOTH)
    np.add.at(count, (rows["gram"].to_numpy(), np.searchsorted(langs, rows["lang"].to_pylist())), rows["n"].to_numpy())
    return Model(langs, np.log(count / count.sum(axis=0)).astype(np.float32))


def _predictor(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text", 1 << 18):
                n = hi - lo
                pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
                shares: list = [[] for _ in range(n)]
                known = np.diff(np.concatenate([[0], np.cumsum(letter[data])])[offsets]) > 0
                for i in np.flatnonzero(~known & (np.diff(offsets) > 0)):
                    known[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
                if model is not None and known.any():
                    starts, ends = word_bounds(data, offsets)
                    doc = np.searchsorted(offsets, starts, "right") - 1
                    use = known[doc]
                    starts, ends, doc = starts[use], ends[use], doc[use]
                    gram, at = _grams(data, starts, ends)
                    ll = np.add.reduceat(model.table[gram], at, axis=0).astype(np.float64)
                    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    weight, _ = mixture(ll, first, len(doc))
                    top = weight.argmax(axis=1)
                    for i, k, w in zip(doc[first].tolist(), top.tolist(), weight.tolist(), strict=True):
                        pred[i], score[i] = model.languages[k], min(1.0, w[k])
                        shares[i] = [(lang, p) for lang, p in zip(model.languages, w, strict=True) if p > 0]
                part = batch.slice(lo, n)
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                mix = pa.array([[{"lang": a, "share": b} for a, b in s] for s in shares], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(part.num_columns)), pa.array(pred.tolist(), pa.string()), pa.array(score), mix], [*part.schema.names, "lang_pred", "score", "languages"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with lang_pred, score (the predicted language's share of the words) and languages, the shares of
    the chosen set. A null text, or one without a letter, is `und` with score 0 and no languages, as is every
    text without a model. Every row is judged by itself: repeated rows, null ids and other columns pass through
    (columns of these three names are replaced).
    """
    docs = docs.drop("lang_pred", "score", "languages")
    schema = with_fields(docs, lang_pred="string", score="double", languages="array<struct<lang:string,share:double>>")
    return docs.transform(map_texts, _predictor(model), schema)
