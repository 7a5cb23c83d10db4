"""The fitted parts of the corpus operators against plain loops, and the oracle queries of the package."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import language_id, quality, quality_rules, toxicity
from quern.llm.queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_match(spark, duck, name):
    got = queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({oracle_sql()[name]}) q").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))


def loop_mixture(ll):
    """One text: proportions of the nested sets, by loops, and the set of best penalised likelihood."""
    n, k = len(ll), len(ll[0])

    def run(weight, rounds):
        for _ in range(rounds):
            new = [0.0] * k
            for row in ll:
                joint = [np.exp(x) * w for x, w in zip(row, weight, strict=True)]
                for j in range(k):
                    new[j] += joint[j] / sum(joint) / n
            weight = new
        return weight, sum(np.log(sum(np.exp(x) * w for x, w in zip(row, weight, strict=True))) for row in ll)

    single = [sum(row[j] for row in ll) for j in range(k)]
    best, value = [float(j == int(np.argmax(single))) for j in range(k)], max(single)
    full, _ = run([1 / k] * k, language_id.ROUNDS)
    order = sorted(range(k), key=lambda j: -full[j])
    for m in range(2, k + 1):
        start = [(full[j] + 1e-3) * (j in order[:m]) for j in range(k)]
        weight, got = run([x / sum(start) for x in start], language_id.ROUNDS // 2)
        got -= language_id.PENALTY * (m - 1) * np.log(n + 1)
        if got > value:
            best, value = weight, got
    return best, value


def test_mixtures_match_a_plain_loop():
    rng = np.random.default_rng(0)
    texts = [rng.normal(-5, 3, (n, 4)) for n in (1, 2, 7, 40)]
    texts.append(np.where(np.arange(60)[:, None] % 2 == np.arange(4) % 2, -1.0, -20.0) - np.arange(4))
    first = np.cumsum([0, *(len(t) for t in texts)])[:-1]
    weight, value = language_id.mixture(np.concatenate(texts), first, sum(map(len, texts)))
    for k, t in enumerate(texts):
        want, v = loop_mixture(t.tolist())
        assert np.allclose(weight[k], want, atol=1e-9) and abs(value[k] - v) < 1e-6
    assert (weight[-1] > 0).sum() == 2


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    pos = rng.normal(2, 1, (3000, 4))
    web = np.concatenate([rng.normal(2, 1, (2100, 4)), rng.normal(-2, 1, (900, 4))])
    prior = quality.estimate_prior(pos, web)
    assert 0.6 < prior <= 0.72
    model = quality._fit(pos, web, prior)
    assert (model.score(rng.normal(2, 1, (500, 4))) > 0.5).mean() > 0.95 > 0.1 > (model.score(rng.normal(-2, 1, (500, 4))) > 0.5).mean()


def test_noisy_or_is_the_chance_of_any_sentence():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0, 0.1)
    logits, doc = np.array([0.3, -2.0, 1.0, -4.0]), np.array([0, 0, 2, 2])
    p = 1 / (1 + np.exp(-logits))
    want = [1 - 0.9 * (1 - p[0]) * (1 - p[1]), 0.1, 1 - 0.9 * (1 - p[2]) * (1 - p[3])]
    assert np.allclose(model.documents(logits, doc, 3), want)


def test_training_moves_weight_to_the_words_of_toxic_sentences():
    rng = np.random.default_rng(2)
    bags, labels = [], []
    for k in range(200):
        bad = k % 4 == 0
        words = rng.integers(0, 50, 12)
        sentence = np.repeat(np.arange(3), 4)
        if bad:
            words[5] = 77
        bags.append((words, sentence, np.ones(12, int), 3))
        labels.append(int(bad))
    model = toxicity.train(bags, np.array(labels), 0.25)
    assert model.weight[77] > 3 * np.abs(model.weight[:50]).max() and not model.weight[100:].any()


def test_accuracies_match_a_plain_loop(spark):
    votes = list(quality_rules.rules().values())
    rng = np.random.default_rng(3)
    rows = [([v if rng.random() < 0.4 else 0 for v, _ in votes], int(rng.integers(1, 90))) for _ in range(30)]
    right = [0.8] * len(votes)
    for _ in range(quality_rules.ROUNDS):
        hit, n = [8.0] * len(votes), [10.0] * len(votes)
        for pattern, count in rows:
            z = sum(v * np.log(a / (1 - a)) for v, a in zip(pattern, right, strict=True))
            good = 1 / (1 + np.exp(-z))
            for k, v in enumerate(pattern):
                if v:
                    hit[k] += count * (good if v > 0 else 1 - good)
                    n[k] += count
        right = [min(0.99, max(0.5, h / m)) for h, m in zip(hit, n, strict=True)]
    df = spark.createDataFrame(rows, "votes array<int>, n long")
    assert np.allclose(quality_rules.accuracies(df), right)
    post = df.select("votes", quality_rules.posterior(right).alias("p")).collect()
    assert all(abs(r.p - 1 / (1 + np.exp(-sum(v * np.log(a / (1 - a)) for v, a in zip(r.votes, right, strict=True))))) < 1e-9 for r in post)


def test_names_that_operators_use_may_clash(spark):
    d = spark.createDataFrame([(k, "one two three four", "x", 1, 2, 3, 4, 5, 6) for k in range(3)], "doc_id long, text string, source string, lang_pred int, languages int, offending int, x int, mark int, size int")
    assert language_id.predict(d, None).count() == 3 == toxicity.score(d, None).count() == quality.score(d, None, "x").count()
    kept = quality_rules.kept_documents(d.withColumn("text", F.concat_ws(" ", *([F.lit("plain words stand here and more of them follow now")] * 2))))
    assert kept.columns == d.columns
