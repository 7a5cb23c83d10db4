"""Bounds that may not cost results: long texts, repeated rows, URLs of many tokens, groups of large sets."""

import gc
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, near_dup, packing, quality, sharding, toxicity, url_filter
from quern.llm.queries import tokenizer_path


def labelled(n):
    texts = [(k, f"good plain words number {k} here. " + ("vile slur appears now. " if k % 2 else "nothing else to say. ")) for k in range(n)]
    return texts, [(k, k % 2) for k in range(n)]


def test_a_very_long_text_does_not_cost_the_model(spark):
    texts, labels = labelled(200)
    texts[1] = (1, "vile slur appears now. " * 1_600_000)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    assert model is not None
    rest = toxicity.score(docs.where("doc_id > 1"), model).collect()
    assert all((r.score >= 0.7) == bool(r.doc_id % 2) for r in rest)


def test_texts_within_bytes(spark):
    rows = [(k, k % 2, size) for k, size in enumerate([900, 40, 30, 10, 20, 10, 400, 400, 30, 10])]
    taken = toxicity._within_bytes(spark.createDataFrame(rows, "doc_id long, label int, size long"), 960).collect()
    # label 0: 900 does not fit, 400 fits after the short ones; label 1: 400 fits
    assert sorted(r.doc_id for r in taken) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    alone = toxicity._within_bytes(spark.createDataFrame([(1, 1, 5000), (2, 1, 9000)], "doc_id long, label int, size long"), 960).collect()
    assert [r.doc_id for r in alone] == [1]


def test_repeated_ids_count_once_in_samples(spark):
    texts, labels = labelled(60)
    docs = spark.createDataFrame(texts + [texts[7]] * 500 + [(7, f"other text {k}") for k in range(50)], "doc_id long, text string")
    same = spark.createDataFrame(texts + [(7, f"other text {k}") for k in range(50)], "doc_id long, text string")
    flags = spark.createDataFrame(labels, "doc_id long, label int")
    a, b = toxicity.fit(docs, flags), toxicity.fit(same, flags)
    assert np.allclose(a.weight, b.weight) and a.bias == pytest.approx(b.bias)
    trusted = flags.where("label = 0").select("doc_id")
    qa, qb = quality.fit(docs, trusted), quality.fit(same, trusted)
    assert qa.prior == pytest.approx(qb.prior)


def brute_combinations(rows, fewest, confidence):
    held, bad = Counter(), Counter()
    for items in rows:
        tokens = sorted(set(items) - {url_filter.BAD})
        for n in range(1, url_filter.TOKENS + 1):
            for c in combinations(tokens, n):
                held[c] += 1
                bad[c] += url_filter.BAD in items
    return sorted((c, round(k / held[c], 9), k) for c, k in bad.items() if k >= fewest and k / held[c] >= confidence)


def test_no_combination_of_many_tokens_is_lost(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RUN_TOKENS", 5)
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(150):
        items = [f"path=p{i}" for i in range(9) if rng.random() < 0.6]
        rows.append(items + ([url_filter.BAD] if {"path=p7", "path=p8"} <= set(items) or rng.random() < 0.3 else []))
    df = spark.createDataFrame([(r,) for r in rows], "items array<string>")
    got = [(c, round(share, 9), n) for c, share, n in url_filter._combinations(df, 10, 0.6)]
    assert got == brute_combinations(rows, 10, 0.6)


def test_the_tenth_token_decides(spark):
    # twelve tokens of high share each, and two of lower share that are bad together only
    rows = []
    for k in range(600):
        some = [f"t{i}" for i in range(12) if (k * 7 + i * 13) % 10 < 8]
        pair = [f for f, on in (("left", k % 2 == 0), ("right", k % 3 == 0)) if on]
        rows.append(("http://h.test/" + "/".join(some + pair) + f"/{k}", k % 6 == 0 or k % 5 < 2))
    rows += [(f"http://fine.test/{k}", False) for k in range(900)]
    rules = [set(r[0]) for r in url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean"))]
    assert {"path=left", "path=right"} in rules


def test_tokens_that_are_bad_together_only_make_rules(spark):
    # half of the URLs are bad: those that hold both parts or neither, so neither part is worse than usual
    rows = []
    for k in range(800):
        held = [p for p, on in (("x", k & 1), ("y", k & 2)) if on]
        rows.append(("http://h.test/" + "/".join([*held, f"n{k}"]), len(held) != 1))
    rules = {frozenset(r[0]): r[1:] for r in url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean"))}
    assert rules == {frozenset({"path=x", "path=y"}): (1.0, 0.25)}


def test_every_token_of_the_same_urls_is_in_the_rule(spark):
    rows = [(f"http://spam.test/buy/now/{k}", True) for k in range(60)] + [(f"http://fine.test/{k}", False) for k in range(200)]
    asked = ["http://spam.org/", "http://a.org/buy/1", "http://b.org/now", "http://fine.test/buys"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(asked)), "page_id long, url string"), spark.createDataFrame(rows, "url string, bad boolean"))
    assert [r.verdict for r in got.orderBy("page_id").collect()] == ["block", "block", "block", "allow"]


def test_arrivals_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "ARRIVAL_BYTES", 10_000)
    table = sharding.ShardTable(spark, f"file://{tmp_path}/t")
    df = spark.range(400).select("id", F.repeat(F.lit("x"), 492).alias("text")).coalesce(1)
    assert len(table.manifest(table.append(df))["shards"]) == 20


def test_sides_of_units_are_cut_by_their_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "UNIT_SHINGLES", 300)
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 9000, 120)]
    texts = []
    for k in range(40):
        w = list(base)
        w[k] = f"own{k}"
        texts.append((k, " ".join(w)))
    members = spark.createDataFrame([(k, 1, 1, 118, 0) for k in range(40)], "rep long, print_a long, print_b long, n_shingles long, cluster long")
    units = near_dup._units(members, 0.8, 40).select("rep", F.explode("units").alias("u")).groupBy("u.unit").count().collect()
    assert max(r["count"] for r in units) < 20
    got = near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 80).collect()
    assert {r.component_id for r in got} == {0}


def test_copies_of_a_row_and_null_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 16)
    rows = [(None, f"text {k} of many words", "a") for k in range(300)] + [(5, "the same text again", "a")] * 200 + [(k, None, None) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    placed, spans = mixing.mix(docs)
    got = placed.where("size > 0").orderBy("at").collect()
    assert [r["at"] for r in got] == list(np.cumsum([0] + [r["size"] for r in got])[:-1]) and placed.count() == 505
    assert sorted(r["copy"] for r in got if r.doc_id == 5) == list(range(200))
    again = [(r.doc_id, r["at"], r["size"]) for r in mixing.mix(docs.repartition(7))[0].where("size > 0").orderBy("at").collect()]
    assert again == [(r.doc_id, r["at"], r["size"]) for r in got]
    mixed = mixing.mixed_documents(docs).collect()
    words = spans.agg(F.sum("length")).first()[0]
    assert sum(len(r.text.split()) for r in mixed) == words and len(mixed) == 500


def test_the_store_of_words_is_small():
    rng = np.random.default_rng(5)
    drawn = ["".join(map(chr, w)) for w in rng.integers(97, 123, (60_000, 9))]
    held = [w + "," * (k % 2) for k, w in enumerate(drawn)]
    texts = [" ".join(held[k : k + 2000]) for k in range(0, len(held), 2000)] + ["", " ".join(reversed(drawn[:2000])), " \n", "Ab ab, AB."]
    tokenizer = packing.WordTokenizer(tokenizer_path())
    tokenizer(np.frombuffer(b"warm", np.uint8), np.array([0, 4]))
    tracemalloc.start()
    for text in texts:
        data = text.encode()
        got = tokenizer(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0][0]
        assert got.tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
        del got, data
    gc.collect()
    grown = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert grown < 100 * len(drawn)
