import random

import numpy as np

from sparkloom.llm import quality, shared
from tests.llm import helpers


def table(spark, n=500):
    random.seed(3)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [random.choice("abcdefghij") * random.randint(1, 3) + random.choice(["ing", "ed", "er"]) for _ in range(random.randint(5, 90))]
        if not good:
            words = random.choice([[w.upper() + "!!" for w in words], [w + "|" for w in words], words[:2] * 40])
        source = random.choice(["good", "mixed"] if good else ["bad", "mixed"])
        rows.append((i, " ".join(words), "en", source, sum(map(len, words))))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, helpers.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_unlabelled_rows_are_told_apart(spark):
    docs, labels = table(spark)
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    odd = [i for i in range(500) if i % 2]
    assert np.mean([got[i]["keep"] == (i % 4 != 0) for i in odd]) > 0.95
    brier = np.mean([(got[i]["score"] - (i % 4 != 0)) ** 2 for i in odd])
    assert brier < 0.05 and all(r["keep"] == (r["score"] >= 0.5) for r in got.values())


def test_views_exchange_pseudo_labels(spark):
    docs, labels = table(spark)
    model = quality.fit(quality.featured(docs, labels).cache(), labelled=80)
    assert model.rounds and sum(map(sum, model.rounds)) > 0
    assert model.combined[1] > 0


def topical(spark, n=600):
    """Texts alike in all statistics; only which words they use tells good from bad."""
    random.seed(11)
    vocabulary = ["".join(random.choices("bcdfghklmnprst", k=3)) + random.choice("aeiou") for _ in range(400)]
    rows = []
    for i in range(n):
        half = vocabulary[:240] if i % 2 else vocabulary[160:]
        text = " ".join(random.choices(half, k=60))
        rows.append((i, text, "en", random.choice(["p", "q"]), len(text)))
    labels = [(i, i % 2, 0) for i in range(n) if i % 3 == 0]
    return spark.createDataFrame(rows, helpers.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ordinary_words_tell_texts_apart(spark):
    docs, labels = topical(spark)
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert np.mean([got[i]["keep"] == (i % 2 == 1) for i in range(600) if i % 3]) > 0.95


def test_against_plain_co_training(spark):
    """Features, pseudo-labels of all documents, fits and scores on one list, without the cluster."""
    docs, labels = table(spark)
    rows, known = docs.orderBy("doc_id").collect(), {r["doc_id"]: r["quality"] for r in labels.collect()}
    found = [quality.text_features(r["text"]) for r in rows]
    text = quality.text_rows(np.array([x for x, _ in found]), np.array([x for _, x in found]))
    meta = np.array([quality.meta_features(r["lang"], r["source"], r["n_chars"]) for r in rows], np.float32)
    fold = {r["doc_id"]: r["fold"] for r in quality.featured(docs, labels).where("quality is not null").collect()}
    free = [i for i, r in enumerate(rows) if r["doc_id"] not in known]

    def pool(*views):
        out = []
        for view, x in zip(views, (text, meta), strict=True):
            p = np.round(1 / (1 + np.exp(-view.logit(x[free]))), 9)
            own = [(i, c) for c, sure in ((0, 1 - p), (1, p)) for i in sorted(sorted(range(len(free)), key=lambda i: (-sure[i], free[i]))[: quality.TAKEN]) if sure[i] >= quality.CONFIDENT]
            at = [free[i] for i, _ in own]
            out.append((text[at], meta[at], np.array([c for _, c in own])))
        return out

    at = [r["doc_id"] for r in rows if r["doc_id"] in known]
    model = quality.co_train(text[at], meta[at], np.array([known[i] for i in at]), np.array([fold[i] for i in at]), pool)
    want = model.score(text, meta)[0]
    got = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    assert np.allclose([got[r["doc_id"]] for r in rows], want, atol=1e-3)


def test_features_are_not_shuffled(spark, monkeypatch):
    """What is staged comes from its texts without an exchange, and all rows are scored so."""
    docs, labels = table(spark)
    plans, staged = {}, shared.staged

    def noted(df, name, *more, **named):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, name, *more, **named)

    monkeypatch.setattr(shared, "staged", noted)
    out = quality.quality(docs, labels)
    assert "Exchange" not in plans["quality-features"] and "Join" not in plans["quality-features"]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_labels_beside_features_or_apart_fit_alike(spark):
    docs, labels = table(spark)
    beside = quality.fit(quality.featured(docs, labels).cache(), 80)
    apart = quality.fit(quality.text_featured(docs).cache(), 80, labels)
    assert beside.rounds == apart.rounds and np.array_equal(beside.combined, apart.combined)


def test_the_fit_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.ones((200, 1)), rng.normal(size=(200, 4))], axis=1)
    y = (x @ [0.3, 1, -2, 0, 0.5] + rng.logistic(size=200) > 0).astype(float)
    w = quality.logistic(x, y, 1.0)
    gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + np.array([1e-3, 1, 1, 1, 1]) * w
    assert np.abs(gradient).max() < 1e-3


def test_edges(spark):
    docs = helpers.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, none).collect()
    assert len(got) == docs.count() and {round(r["score"], 6) for r in got} == {0.5}
    odd = spark.createDataFrame([(None, 1, 0), (6, None, 0), (6, 1, 0), (6, 0, 0), (5, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.quality(docs, odd).collect())
    assert quality.quality(helpers.empty(spark), odd).count() == 0
    assert all(np.isfinite(x).all() for x in quality.text_features(helpers.LONG)) and np.isfinite(quality.meta_features(None, None, None)).all()


def test_statistics_and_pieces(monkeypatch):
    text = "One two TWO two. two two|\n\nÉtat 3x http://a.b end%%\tend%%\nOne line"
    stats, hashed = quality.text_features(text)
    named = dict(zip(quality.STATISTICS, stats.tolist(), strict=True))
    words = text.split()
    assert named["log_words"] == np.float32(np.log1p(len(words))) and np.isclose(named["distinct_share"], len(set(words)) / len(words))
    assert np.isclose(named["repeat_share"], 1 / len(words)) and np.isclose(named["shout_share"], 1 / len(words)) and np.isclose(named["odd_ends"], 3 / len(words))
    assert np.isclose(named["ended_share"], sum(w.isalpha() for w in words) / len(words)) and np.isclose(named["word_length"], np.mean([len(w.encode()) for w in words]) / 10)
    long = " ".join(random.Random(1).choices(["aa", "bb", "Cc!", "d1", "é"], k=4000))
    whole = quality.text_features(long)
    monkeypatch.setattr(quality, "PIECE", 700)
    cut = quality.text_features(long)
    assert np.allclose(whole[0], cut[0])
    # trigrams over the cuts, two for each, are all that differs
    assert (np.abs(whole[1].astype(int) - cut[1]) <= 2).all()
