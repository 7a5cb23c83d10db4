"""Quality rules under weak supervision, in DataFrame expressions only.

Each rule looks at one measured property of a text and votes good, bad or abstains. The votes of all
documents are counted by vote pattern (a few hundred rows at most); expectation-maximisation on those counts
estimates how often each rule is right; a document is kept by its posterior probability of being good, not by
passing every rule.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?"
WINDOW = 5
ROUNDS = 12
#: A document is kept where its posterior is at least this.
KEEP = 0.5


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, tuple[int, Column]]:
    """name: (vote, where). -1 speaks for bad, 1 for good; elsewhere the rule abstains."""
    symbols, repeats = _share("n_symbols", "n_words"), _share("n_repeat_words", "n_words")
    lines, ups, length = _share("n_dup_lines", "n_lines"), _share("n_upper", "word_chars"), _share("word_chars", "n_words")
    marks, kinds = _share("n_marks", "n_words"), _share("n_kinds", "n_words")
    sober = (symbols < 0.05) & (ups < 0.15) & (marks < 0.05)
    return {
        "symbols": (-1, symbols > 0.2),
        "repeats": (-1, repeats > 0.2),
        "lines": (-1, lines > 0.3),
        "capitals": (-1, ups > 0.4),
        "word_length": (-1, (length < 2.5) | (length > 15)),
        "exclamations": (-1, marks > 0.2),
        "vocabulary": (-1, (F.col("n_words") >= 50) & (kinds < 0.1)),
        "size": (-1, F.col("n_words") < 10),
        "plain": (1, sober & length.between(3, 12)),
        "varied": (1, sober & (kinds > 0.25) & (repeats < 0.05)),
    }


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row and not kept as a column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _paired(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))


def _window_hashes(words: Column) -> Column:
    """A hash of each window of five words: of its first four (two pairs of neighbours) and its last."""
    n = F.size(words)
    two = _paired(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1))
    four = _let(two, lambda t: _paired(F.slice(t, 1, n - 4), F.slice(t, 3, n - 4)))
    return _paired(four, F.slice(words, 5, n - 4))


def _covered(words: Column, hashes: Column) -> Column:
    """Words in windows found twice: neighbours in the order of (hash, position) that agree in hash and all words."""

    def agree(x: Column, y: Column) -> Column:
        same = F.slice(words, x["at"] + 1, WINDOW) == F.slice(words, y["at"] + 1, WINDOW)
        return F.coalesce((x["h"] == y["h"]) & same, F.lit(False))

    def count(entries: Column) -> Column:
        again = F.filter(entries, lambda x, i: agree(x, F.get(entries, i - 1)) | agree(x, F.get(entries, i + 1)))
        places = F.sort_array(F.transform(again, lambda x: x["at"]))
        width = F.lit(WINDOW)
        reach = _let(places, lambda t: F.transform(t, lambda p, i: F.least(width, F.coalesce(F.get(t, i + 1) - p, width))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    return _let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), count)


def _repeat_words(words: Column) -> Column:
    """Most texts have no two windows of one hash: only the others are sorted and compared by their words."""
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(words, h)).otherwise(F.lit(0))
    return F.when(F.size(words) >= WINDOW, _let(_window_hashes(words), some)).otherwise(F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """The measured properties of whole texts in place of `text`, beside the other columns; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]")))
    signs = F.regexp_replace(text, f"[^{CAPITALS}{re.escape(SYMBOLS + MARKS)}]+", "")
    long = lambda x, name: x.cast("long").alias(name)
    count = lambda s, chars, name: long(F.length(s) - F.length(F.translate(s, chars, "")), name)
    by_words = lambda w: F.struct(long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"), long(_repeat_words(w), "n_repeat_words"), long(F.size(F.array_distinct(w)), "n_kinds"))
    by_lines = lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"))
    by_signs = lambda s: F.struct(count(s, SYMBOLS, "n_symbols"), count(s, CAPITALS, "n_upper"), count(s, MARKS, "n_marks"))
    parts = {"q_words": _let(words, by_words), "q_lines": _let(lines, by_lines), "q_signs": _let(signs, by_signs)}
    others = [c for c in docs.columns if c != "text"]
    d = docs.select(*others, *(v.alias(k) for k, v in parts.items()))
    return d.select(*others, *(f"{k}.*" for k in parts)).select(*others, *MEASURES)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_kinds")


def _votes(d: DataFrame) -> DataFrame:
    return d.withColumn("votes", F.array(*(F.when(where, vote).otherwise(0) for vote, where in rules().values())))


def accuracies(patterns: DataFrame, rounds: int = ROUNDS) -> list[float]:
    """For each rule the chance that its vote is right.

    `patterns` has votes and n, the documents with them: at most 2 to the number of rules rows, whatever the corpus.
    The classes start even, a rule starts as right in 8 of 10 cases (and is smoothed by as many), and no rule may
    fall under an even chance: it would then speak for the other side.
    """
    right = [0.8] * len(rules())
    for _ in range(rounds):
        w = patterns.withColumn("g", posterior(right))
        sums = []
        for k, (vote, _) in enumerate(rules().values()):
            voted = F.get("votes", F.lit(k)) != 0
            sums += [F.sum(F.when(voted, F.col("n") * (F.col("g") if vote > 0 else 1 - F.col("g")))), F.sum(F.when(voted, F.col("n")))]
        row = w.agg(*sums).first()
        right = [min(0.99, max(0.5, ((row[2 * k] or 0) + 8) / ((row[2 * k + 1] or 0) + 10))) for k in range(len(right))]
    return right


def posterior(right: list[float]) -> Column:
    """Probability that a document with these `votes` is good; an abstention says nothing."""
    z = F.lit(0.0)
    for k, a in enumerate(right):
        z = z + F.get("votes", F.lit(k)) * math.log(a / (1 - a))
    return 1 / (1 + F.exp(-z))


def _judged(rows: DataFrame) -> DataFrame:
    """`rows` (text and whatever else) with the measures and the verdict."""
    d = materialize(_votes(measures(rows)))
    right = accuracies(d.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).transform(materialize))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = d.withColumn("base_failed", failed).withColumn("posterior", posterior(right))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, the measures, base_failed, posterior, kept.

    base_failed: fewer than 10 words, or over 20 in 100 words in a 5-word window that occurs twice in the text.
    kept: not base_failed and a posterior of at least KEEP. Null and empty texts measure zero and fail; ids may
    be null or repeat, every row is judged by itself; an empty table gives no rows; other columns are ignored.
    """
    return _judged(docs.select("doc_id", "text")).select("doc_id", *MEASURES, "base_failed", "posterior", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns."""
    return _judged(docs.select(F.struct("*").alias("row"), F.col("text"))).where("kept").select("row.*")
