"""Packing token streams into sequences by order-preserving dynamic programming.

The documents of a partition form one token stream in their order. Cut candidates are document ends
(free), sentence ends (a small penalty) and, only inside long unbroken stretches, evenly spaced positions
(a large penalty). The program picks the cuts that minimise padding plus penalties; since the cost of a
window is (capacity - length), the best predecessor is a sliding-window minimum, kept by a monotone queue.
The stream is solved in bounded pieces: the last window of a piece stays open and starts the next one, so
padding from the end of a stream occurs once in a partition. No shuffle takes place.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterator
from types import ModuleType
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, slices, span_hashes, word_bounds

CAPACITY = 2048
END_ID = 1
SENTENCE_CUT = 8
HARD_CUT = 64
HARD_GAP = 128
#: Tokens solved at once.
SPAN = 1 << 18
#: Distinct words after which the tokenizer's store is emptied, and bytes of text that it takes at once.
CACHE = 600_000
BITE = 1 << 21

_TRAIL = frozenset(".,!?;:")
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Token ids of texts, word by word: the vocabulary's normaliser and splitter never join across white space.

    Each distinct word of a slice (by its 64-bit hash, A-Z folded as the vocabulary folds them) is encoded
    once and kept in a bounded store of flat arrays; the ids of the slice are then one gather. A word of Latin letters is a
    single split, so its merges are asked of the tokenizer's model directly, with one trailing mark as a
    split of its own; every other word, and a whole text that may hold a special token, goes to the tokenizer
    as it stands.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.foldable = re.compile("[\x00-\u012f\u0131-\u024f]*").fullmatch
        self._reset()

    def _reset(self) -> None:
        # the words' hashes, ascending, and where the ids of each lie in the pool
        self.known = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)
        self.stems: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _stem(self, word: str) -> bytes:
        """`word`: Latin letters in lower case, or one mark."""
        got = self.stems.get(word)
        if got is None:
            if word.isascii() and word.isalpha():
                got = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
            elif word.isalpha() and is_normalized("NFC", word):
                got = array("I", [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))]).tobytes()
            else:
                got = self.encode(word)
            self.stems[word] = got
        return got

    def _word(self, word: str) -> bytes:
        if self.foldable(word):
            low = word.lower()
            if low.isalpha():
                return self._stem(low)
            if low[-1] in _TRAIL and low[:-1].isalpha():
                return self._stem(low[:-1]) + self._stem(low[-1])
        return self.encode(word)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Keeps the ids of new words; keys: their hashes, ascending."""
        got = list(map(self._word, words))
        self.stems.clear()  # words of one slice share them; as a store they would be larger than the ids
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.starts = np.insert(self.starts, at, len(self.pool) + np.cumsum(size) - size)
        self.sizes = np.insert(self.sizes, at, size)
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(got), np.uint32)])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text of a slice its ids and the token positions after which a sentence or line ends."""
        import pandas as pd

        if len(self.known) > CACHE:
            self._reset()
        with np.errstate(over="ignore"):
            starts, ends = word_bounds(data, offsets)
            code, keys = pd.factorize(span_hashes(data, starts, ends), sort=True)
        raw = data.tobytes()
        new = np.flatnonzero(~np.isin(keys, self.known, assume_unique=True))
        if len(new):
            first = np.empty(len(keys), np.int64)
            first[code] = np.arange(len(code))
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            self._learn(keys[new], [raw[a:b].decode() for a, b in spans])
        word = np.searchsorted(self.known, keys)[code]
        size = self.sizes[word]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.starts[word] - upto[:-1], size) + np.arange(upto[-1])]
        stop = _STOP[data[ends - 1]] | (np.append(data, 10)[ends] == 10)
        edge = np.searchsorted(starts, offsets)
        out = []
        for k in range(len(offsets) - 1):
            a, b = edge[k], edge[k + 1]
            text = raw[offsets[k] : offsets[k + 1]]
            if b"<|" in text:
                out.append((np.frombuffer(self.encode(text.decode()), np.uint32), np.zeros(0, np.int64)))
            else:
                out.append((ids[upto[a] : upto[b]], upto[a + 1 : b + 1][stop[a:b]] - upto[a]))
        return out


def _tokenizer(path: str) -> WordTokenizer:
    """The worker process's tokenizer: functions travel by value, so a global of this module would end with its task."""
    held = vars(sys.modules.setdefault("quern_worker", ModuleType("quern_worker")))
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Indices of the chosen cuts, the first and the last included.

    cuts ascend strictly from 0 and no gap exceeds `capacity`. The cost of a window from cut i to cut j is
    capacity - (cuts[j] - cuts[i]) + penalty[j].
    """
    pos, fee = cuts.tolist(), penalty.tolist()
    n = len(pos)
    cost, back = [0.0] * n, [0] * n
    queue, head = [0], 0
    for j in range(1, n):
        at = pos[j]
        while at - pos[queue[head]] > capacity:
            head += 1
        i = queue[head]
        best = cost[i] + pos[i] - at + capacity + fee[j]
        cost[j], back[j] = best, i
        key = best + at
        while len(queue) > head and cost[queue[-1]] + pos[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [n - 1], n - 1
    while j:
        j = back[j]
        out.append(j)
    return np.array(out[::-1])


def _candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    soft = np.unique(np.concatenate([[0], sentence_ends, doc_ends, [total]]))
    gap = np.diff(soft)
    wide = np.flatnonzero(gap > 2 * HARD_GAP)
    hard = [np.arange(soft[k] + HARD_GAP, soft[k + 1], HARD_GAP) for k in wide]
    cuts = np.unique(np.concatenate([soft, *hard])).astype(np.int64)
    fee = np.full(len(cuts), HARD_CUT, np.int64)
    fee[np.isin(cuts, sentence_ends)] = SENTENCE_CUT
    fee[np.isin(cuts, doc_ends)] = 0
    return cuts, fee


def _packer(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenize = _tokenizer(tokenizer_path)
        first_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        stop = np.array([END_ID], "<u4").tobytes()
        # the open stream: token bytes, and for each document (id, stream position of its first token, length)
        stream, held, docs, sentences, n_seq = [], 0, [], [], 0

        def solve(last: bool) -> pa.RecordBatch | None:
            nonlocal stream, held, docs, sentences, n_seq
            data = b"".join(stream)
            starts = np.array([d[1] for d in docs], np.int64)
            sizes = np.array([d[2] for d in docs], np.int64)
            marks = np.concatenate([m for m in sentences]) if sentences else np.zeros(0, np.int64)
            cuts, fee = _candidates(starts + sizes, marks[(marks > 0) & (marks < held)], held)
            edges = cuts[best_cuts(cuts, fee)]
            done = held if last else int(edges[-2])
            if not done:
                return None
            edges = edges[edges <= done]
            points = np.unique(np.concatenate([edges, np.maximum(starts[starts < done], 0)]))
            begin, length = points[:-1], np.diff(points)
            doc = np.searchsorted(starts, begin, "right") - 1
            seq = np.searchsorted(edges, begin, "right") - 1
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([docs[k][0] for k in doc], pa.int64()), pa.array(begin - starts[doc]), pa.array(length), pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((points * 4).astype(np.int32).tobytes()), pa.py_buffer(data[: done * 4])]),
                    pa.array(sizes[doc]), pa.array(first_id + n_seq + seq), pa.array(begin - edges[seq]),
                ],
                ["doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"],
            )
            n_seq += len(edges) - 1
            stream, held = [data[done * 4 :]], held - done
            docs = [(i, s - done, n) for i, s, n in docs if s + n > done]
            sentences = [marks[marks > done] - done]
            return out

        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text", BITE):
                for i, (ids, ends) in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), tokenize(data, offsets), strict=True):
                    n = len(ids) + 1
                    docs.append((i, held, n))
                    sentences.append(held + ends)
                    stream += [ids.astype("<u4").tobytes(), stop]
                    held += n
                    if held >= SPAN and (out := solve(False)):
                        yield out
        if held:
            yield solve(True)

    return run


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, tokens (little-endian unsigned 32-bit ids),
    doc_tokens, sequence_id, offset.

    Every document (doc_id, text) gives the ids of its text and an end id; each id lies in exactly one piece,
    pieces lie gapless in sequences of at most 2048 tokens, and documents keep their order within a
    partition. A null or empty text is its end id alone; a null doc_id is carried through; repeated rows are
    packed each; a stretch without a boundary is cut at fixed positions; an empty table gives no rows.
    Other columns are ignored. A document longer than the span that is solved at once is held whole.
    """
    schema = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_texts, _packer(tokenizer_path), schema)
