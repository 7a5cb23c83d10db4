import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import common, language_id, mixing, near_dup, packing, quality, quality_rules, sharding, topk, toxicity, url_filter
from quern.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, votes string, kept string, row string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, start=0):
    rows = [(start + k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), "clash", "clash", "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    rng = np.random.default_rng(1)
    long = " ".join(rng.choice(["alpha", "beta", "gamma,", "Delta.", "naïve", "x1"], 4000))
    return [None, "", "   \n\t", "a", "a b", "one two three four", "one two three four", "!!! ??? ###", "éàü ñ", "tab\tand\x0bvt\x0cff", long, long + " tail", "line\nline\nline\nother", "<|endoftext|> special <|x", " nbsp wide", "UPPER lower MiXed 123."]


@pytest.fixture(scope="module")
def odd(spark):
    df = docs_of(spark, odd_texts())
    return df.unionByName(df.where("doc_id = 5")).unionByName(df.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))


def words(t):
    return WORDS.findall(t or "")


def shingle_set(t, width):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(texts, width, percent):
    sets, root = [shingle_set(t, width) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def family(n, size, seed, change):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, size)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, size, rng.integers(0, change)):
            w[at] = f"v{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_match_brute_force(spark):
    texts = [*odd_texts(), *family(330, 60, 2, 4), *family(20, 90, 3, 6), *family(5, 12, 4, 2)]
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs_of(spark, texts), 3, 85).collect()}
    roots, sizes = brute_components(texts, 3, 85)
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (roots[i] == i) for i in got)


def test_near_duplicate_edge_rows(spark, odd):
    out = near_dup.near_duplicates(odd).collect()
    assert len(out) == odd.count() and [r.kept for r in out if r.doc_id is None] == [True]
    once = near_dup.deduplicated(odd)
    assert once.columns == odd.columns and Counter(r.doc_id for r in once.collect())[5] == 1
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0 == near_dup.deduplicated(odd.limit(0)).count()


def test_bands_miss_little():
    m = near_dup.collections(0.85)
    assert 2 * (1 - 0.85**near_dup.ROWS) ** m <= near_dup.MISS


def test_language_sets_and_edges(spark, odd):
    en, fr = "the cat and the dog run in the house with the others", "le chat et le chien courent dans la maison avec les autres"
    train = spark.createDataFrame([(k, (en if k % 2 else fr), "en" if k % 2 else "fr") for k in range(40)] + [(99, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert model.languages == ["en", "fr"]
    got = [(r.lang_pred, r.score, len(r.languages)) for r in language_id.predict(docs_of(spark, [en, fr, (en + " ") * 4 + (fr + " ") * 6, None, "12 !?"]), model).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["en", "fr", "fr", "und", "und"] and got[2][2] == 2 and 0.5 < got[2][1] < 0.75 and got[3][1] == 0
    assert language_id.predict(odd, model).count() == odd.count() and language_id.fit(train.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (400, 6)).astype(float) / 64
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(400 + k, v[0].tolist()) for k in range(60)] + [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (0, v[0].tolist())]
    q = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in topk.top_k(q, F.col("vec_id") % 20 == 0, 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ints = {i: np.floor(64 * np.array(x)).astype(int) for i, x in rows[:460]}
    for i in ints:
        if i % 20 == 0:
            want = sorted((-int(ints[i] @ x), j) for j, x in ints.items() if j != i)[:7]
            assert [got[i][k] for k in range(1, 8)] == [(j, -s) for s, j in want]
    few = topk.top_k(q.where("vec_id < 3"), F.col("vec_id") == 0, 20)
    assert few.count() == 2 and topk.top_k(q.limit(0), F.lit(True), 3).count() == 0


def brute_rows(rows, k):
    """(query id, rank, id, score) over rows: every row of a query meets every row of another id."""
    out = []
    for own in {i for i, _ in rows if i % 20 == 0}:
        pairs = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for i, q in rows if i == own for j, x in rows if j != own)
        out += [(own, n, j, -s) for n, (s, j) in enumerate(pairs[:k], 1)]
    return sorted(out)


def test_repeated_rows_and_shared_ids_are_candidates_each(spark):
    rng = np.random.default_rng(11)
    rows = [(k, rng.integers(-3, 4, 4).tolist()) for k in range(120)]
    best = [9, 9, 9, 9]
    rows += [(7, best)] * 3 + [(8, best)] * 30 + [rows[40]] * 2 + [(20, [-2, 1, 0, 3])] + [(60, [9 + j, 9, 9, 9]) for j in range(12)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    for k in (5, 20):
        assert sorted(map(tuple, topk.top_k(v, F.col("vec_id") % 20 == 0, k, each_row=True).collect())) == brute_rows(rows, k)
    # an id of many vectors that are all better than the rest leaves its queries k others
    once = topk.top_k(v, F.col("vec_id") == 60, 20).collect()
    assert len(once) == 20 and all(r.vec_id != 60 for r in once)


def test_the_bound_may_leave_64_bits(spark):
    big = 1 << 30
    rows = [(0, [big] * 16)] + [(k, [big if k % 16 == j else -2 for j in range(16)]) for k in range(1, 200)] + [(k, [big // 15] * 16) for k in range(201, 219)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") == 0, 20)
    assert sorted(map(tuple, got.collect())) == [r for r in brute_rows(rows, 20) if r[0] == 0]


def test_threshold_search_stops_early():
    v = np.diag(np.arange(1, 2001)[::-1])[:, :8].astype(np.int64)
    rows, ids, scores = topk.threshold_search(np.array([[5, 0, 0, 0, 0, 0, 0, 0]]), np.array([-1]), v, [np.array([k]) for k in range(2000)], 1)
    assert ids == [0] and scores == [10000]


def test_lists_run_on_until_the_bound_stops():
    rng = np.random.default_rng(5)
    v = np.floor(64 * (rng.normal(size=(4000, 1)) * np.ones(16) + rng.normal(size=(4000, 16)))).astype(np.int64)
    order, ids = np.argsort(-v, axis=0, kind="stable"), [np.array([k]) for k in range(4000)]
    for row in range(0, 4000, 400):
        q = np.abs(v[row])
        pairs, met = topk._read_lists(q, q, row, v, v, order, ids, 20)
        assert pairs == sorted((-int(v[i] @ q), i) for i in range(4000) if i != row)[:20]
        assert met < 4000  # the bound has stopped it
    rows, ids_, scores = topk.threshold_search(np.zeros((1, 16), np.int64), np.array([0]), v, ids, 3)
    assert (rows, ids_, scores) == ([0] * 3, [1, 2, 3], [0] * 3)


def test_shares_follow_the_rule():
    s = mixing.shares({"a": 100, "b": 1000, None: 10})
    assert s[None] == 20 and s["a"] == 200 and s["b"] == Fraction(3, 2) * 1110 - 220
    assert mixing.shares({"a": 0}) == {"a": 0}
    d = list(mixing.shard_draws([5, 0, 7], range(3), shard=4))
    assert sorted(r for s in (2, 0, 1) for r in mixing.shard_draws([5, 0, 7], [s], shard=4)) == d
    assert sum(n for _, k, _, n in d if k == 0) == 5 and sum(n for _, k, _, n in d if k == 2) == 7
    assert all(sum(n for s2, _, _, n in d if s2 == t) == 4 for t in range(3))


def test_block_permutation_is_one(spark):
    n = 1000
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(0))).collect()]
    assert sorted(got) == list(range(n)) and got != sorted(got)


def test_mix_takes_its_targets(spark, odd):
    texts = family(120, 700, 5, 50) + odd_texts()
    d = docs_of(spark, texts).unionByName(docs_of(spark, texts[-3:], 130))
    placed, spans = mixing.mix(d)
    size = {r.source: r.s for r in placed.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    taken = {r.k: r.t for r in spans.groupBy("k").agg(F.sum("length").alias("t")).collect()}
    for r in placed.select("source", "k", "source_size", "target").distinct().collect():
        assert r.source_size == size[r.source] and abs(taken[r.k] - r.target) <= 2 * mixing.BLOCK
    by = spans.groupBy("k", "at").agg(F.sum("length").alias("t")).join(placed.where("size > 0"), ["k", "at"])
    assert by.where("t > 2 * size").count() == 0 and placed.count() == d.count()
    assert sum(r.size for r in placed.collect()) == sum(len(words(r.text)) for r in d.collect())
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns and sum(len(words(r.text)) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(odd.limit(0))[1].count() == 0 and mixing.mixed_documents(odd).count() > 0


def test_quality_learns_from_positives_and_unlabelled(spark, odd):
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice(["the", "house", "of", "a", "green", "tree", "stands."], 60)) for _ in range(300)]
    junk = [" ".join(f"{w}###" for w in rng.choice(["x", "yy", "zzz"], 60)) for _ in range(100)]
    d = docs_of(spark, clean + junk)
    model = quality.fit(d, d.where("doc_id < 100").select("doc_id"))
    got = [r.score for r in quality.score(d, model).orderBy("doc_id").collect()]
    assert min(got[:300]) > 0.3 > max(got[300:]) and 0.5 < model.prior < 0.9
    out = quality.score(odd, model, "kept")
    assert out.count() == odd.count() and all(0 <= r.kept <= 1 for r in out.collect())
    assert quality.fit(d, d.limit(0).select("doc_id")) is None and quality.score(odd.limit(0), None).count() == 0


def test_toxicity_finds_sentences(spark, odd):
    rng = np.random.default_rng(0)
    calm = lambda n: " ".join(rng.choice(["the", "house", "of", "a", "green", "tree", "stands"], n)) + "."
    text = [" ".join([calm(8), f"You are {'vile' if k % 2 else 'vilest'} {calm(3)}", calm(5)] if k < 150 else [calm(8), calm(8)]) for k in range(400)]
    d = docs_of(spark, text)
    model = toxicity.fit(d, d.select("doc_id", (F.col("doc_id") < 150).cast("int").alias("label")))
    rows = toxicity.score(d, model).orderBy("doc_id").collect()
    assert min(r.score for r in rows[:150]) >= 0.7 > max(r.score for r in rows[150:])
    assert all("vile" in s.sentence for r in rows[:150] for s in r.offending) and not any(r.offending for r in rows[150:])
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.fit(d, d.limit(0).selectExpr("doc_id", "1 as label")) is None


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    d = docs_of(spark, [*odd_texts(), "ß ſ ǅ İstanbul ΑΣ Σ don't we'll 3.14 a--b é", "x" * 9000, *family(40, 500, 6, 9)])
    rows = packing.pack(d.repartition(2, "doc_id"), tokenizer_path()).collect()
    text, pieces, seqs = {r.doc_id: r.text for r in d.collect()}, {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(text)
    for i, ps in pieces.items():
        ps.sort(key=lambda r: r.start)
        want = [*tok.encode(text[i] or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(p.tokens for p in ps), "<u4").tolist() == want and {p.doc_tokens for p in ps} == {len(want)}
        assert [p.start for p in ps] == np.cumsum([0, *(p.length for p in ps)])[:-1].tolist()
    for ps in seqs.values():
        ps.sort(key=lambda r: r.offset)
        assert [p.offset for p in ps] == np.cumsum([0, *(p.length for p in ps)])[:-1].tolist() and sum(p.length for p in ps) <= 2048
    used = sum(r.length for r in rows)
    assert len(seqs) * 2048 <= used * 1.05 + 2 * 2048
    assert packing.pack(odd, tokenizer_path()).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert packing.pack(odd.limit(0), tokenizer_path()).count() == 0


def test_best_cuts_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(50):
        cuts = np.concatenate([[0], np.cumsum(rng.integers(1, 8, 14))])
        fee = rng.integers(0, 6, len(cuts))
        best = [0] + [10**9] * (len(cuts) - 1)
        for j in range(1, len(cuts)):
            best[j] = min(best[i] + 10 - (cuts[j] - cuts[i]) + fee[j] for i in range(j) if cuts[j] - cuts[i] <= 10)
        got = packing.best_cuts(cuts, fee, 10)
        assert sum(10 - (cuts[b] - cuts[a]) + fee[b] for a, b in zip(got, got[1:], strict=False)) == best[-1] and got[0] == 0 and got[-1] == len(cuts) - 1


def test_url_rules(spark):
    urls = [None, "no scheme", "", "http://A.COM/en/1", "https://x.example.com/en/7?q#f", "https://x.example.com/en/7", "http://de.net/de/", "http://example.net/de/8", "ftp://example.net#a", "http://y.org?x=/es/", "http://y.org/es/", "http://notexample.com/fr"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "url string, bad boolean")).orderBy("page_id").collect()
    assert [(r.host, r.path) for r in got[:5]] == [("", "")] * 3 + [("a.com", "/en/1"), ("x.example.com", "/en/7")]
    assert [r.rule for r in got] == [None, None, None, "com/en/", "example.com/en/7", "example.com/en/7", "net/de/", "example.net/de/8", None, None, "org/es/", None]
    assert [r.verdict for r in got][3:] == ["block", "allow", "allow", "allow", "block", "allow", "allow", "block", "allow"]


def test_url_rules_are_mined(spark):
    rows = [(f"http://{'spam' if k % 3 == 0 else 'fine'}.test/{'buy' if k % 2 else 'read'}/{k}", k % 6 == 3) for k in range(120)]
    rules = url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean"), support=0.05, confidence=0.9)
    assert {"host=spam", "path=buy"} in [set(r[0]) for r in rules] and all(r[1] >= 0.9 for r in rules)
    want = [any(set(r[0]) <= {f"host={u.split('/')[2].split('.')[0]}", "host=test", f"domain={u.split('/')[2]}", f"path={u.split('/')[3]}"} for r in rules) for u, _ in rows]
    assert want == [bad for _, bad in rows]


def test_tokens_that_come_together_are_mined_as_one(spark):
    rows = [("http://spam.test/" + "/".join(f"part{i}" for i in range(12)) + f"/{k}", True) for k in range(60)] + [(f"http://fine.test/{k}", False) for k in range(200)]
    assert [r[0] for r in url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean"))] == [("host=spam",)]
    # nearly together: each URL lacks one of the parts
    rows = [("http://spam.test/" + "/".join(f"part{i}" for i in range(14) if i != k % 14) + f"/{k}", True) for k in range(140)] + [(f"http://fine.test/{k}", False) for k in range(200)]
    rules = [r[0] for r in url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean"))]
    assert ("host=spam",) in rules and all(len(r) == 1 for r in rules)


def test_samples_survive_repeated_rows(spark):
    ids = spark.range(2000).select(F.col("id").alias("doc_id")).crossJoin(spark.range(50).select(F.lit(1).alias("one"))).drop("one")
    assert common.hash_sample(ids, 1000, 3).count() == 1000
    by = ids.withColumn("kind", F.col("doc_id") % 2)
    assert [r.n for r in common.hash_sample(by, 300, 3, "kind").groupBy("kind").agg(F.count("*").alias("n")).collect()] == [300, 300]


def test_column_names_with_backticks_pass_through(spark):
    d = spark.createDataFrame([(1, "one two", 5)], "doc_id long, text string, n int").withColumnRenamed("n", "a`b c")
    for out in (quality.score(d, None), language_id.predict(d, None), toxicity.score(d, None)):
        assert out.columns[:3] == d.columns and out.count() == 1


def test_url_rules_need_a_count_not_a_share(spark):
    schema = "url string, bad boolean"
    few = [(f"http://h{k % 7}.test/{k}", k % 5 == 0) for k in range(98)]
    assert url_filter.mine(spark.createDataFrame(few, schema)) == []
    many = [(f"http://{'spam' if k % 1000 == 7 else 'fine'}.test/{k % 50}/{k}", k % 1000 == 7 or k % 5 == 0) for k in range(20_000)]
    assert [r[0] for r in url_filter.mine(spark.createDataFrame(many, schema)) if "host=spam" in r[0]] == [("host=spam",)]
    usual = [(f"http://h.test/{k}", k % 10 < 9) for k in range(200)]
    assert url_filter.mine(spark.createDataFrame(usual, schema)) == []


def test_rules_measure_like_brute_force(spark, odd):
    texts = [*odd_texts(), "a b c d e a b c d e f g", "x y z w v " * 30, "THE!! BIG!! END!! " * 8, *family(30, 80, 8, 3), *(" ".join(f"{w}###" for w in f.split()) for f in family(8, 40, 9, 3))]
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if count[g] > 1:
                covered |= set(range(k, k + 5))
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)), t
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert all(got[19 + k].kept for k in range(30)) and not any(got[49 + k].kept for k in range(8))
    kept = quality_rules.kept_documents(odd)
    assert kept.columns == odd.columns and quality_rules.judge(odd).count() == odd.count() and quality_rules.judge(odd.limit(0)).count() == 0


def test_repeats_are_found_beside_windows_of_like_hash(spark):
    # "a b c d w1586667" and "a b c d w2453334" agree in the low 40 bits of their hash, other windows are unique
    texts = ["a b c d w1586667 f0 a b c d w2453334 f1 a b c d w1586667", "a b c d w2453334 f0 a b c d w1586667 f1 a b c d w2453334"]
    assert [r.n_repeat_words for r in quality_rules.judge(docs_of(spark, texts)).orderBy("doc_id").collect()] == [10, 10]


def test_shards_merge_and_commit(spark, tmp_path, odd):
    t = sharding.ShardTable(spark, f"file://{tmp_path}/t", target=40_000)
    for k in range(4):
        assert t.append(odd, rows=3) == k + 1
    before = t.manifest()
    after = t.manifest(t.compact())
    assert len(after["shards"]) < len(before["shards"]) and not t.plan(after)
    key = lambda df: Counter(map(tuple, df.collect()))
    assert key(t.read()) == key(t.read(4)) == Counter({k: 4 * n for k, n in key(odd).items()})
    with pytest.raises(RuntimeError):
        t._commit(before, before["shards"], before["schema"])
    with pytest.raises(ValueError):
        t.append(odd.withColumn("n_chars", F.col("n_chars").cast("string")))
    assert t.vacuum() == 0 and t.vacuum(0) > 0 and key(t.read()) == Counter({k: 4 * n for k, n in key(odd).items()}) and len(t.versions()) == 1
    e = sharding.ShardTable(spark, f"file://{tmp_path}/e")
    e.append(odd.limit(0))
    assert e.read().count() == 0 and e.read().columns == odd.columns


def test_slices_and_words_agree_with_a_regex(spark):
    import pyarrow as pa

    texts = odd_texts() * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(2)
    seen = 0
    for lo, hi, data, offsets in common.slices(batch, "text", 500):
        h, first = common.words(data, offsets)
        for i in range(lo, hi):
            own = h[first[i - lo] : first[i - lo + 1]]
            w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(texts[2 + i])]
            assert len(own) == len(w) and len(set(own.tolist())) == len(set(w))
            seen += 1
    assert seen == len(texts) - 2


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(2)
    text = lambda: ". ".join(" ".join(rng.choice([f"word{k}" for k in range(300)], 12)) for _ in range(6))
    clean = [text() for _ in range(150)]
    d = docs_of(spark, clean + clean[:20] + [" ".join(f"{w}&&&" for w in text().split()) for _ in range(40)] + odd_texts())
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES[:3]:
        docs = common.materialize(stage(spark, docs, str(tmp_path)))
        ids = {r.doc_id for r in docs.collect()}
        counts.append(len(ids))
        assert docs.columns == d.columns and set(range(150)) <= ids, name
    assert not ids & set(range(150, 210))
    pieces = P.run(spark, str(tmp_path)).collect()
    assert pieces and all(p.length > 0 for p in pieces)
