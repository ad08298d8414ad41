import pickle
import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import shared, toxicity
from sparkloom.llm.toxicity import Index
from tests.llm import helpers

BAD = ["snarl", "grubber", "vilest"]


def table(spark, n=600):
    random.seed(7)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = [random.choice(words) for _ in range(random.randint(1, 80))]
        if toxic:
            text.insert(random.randint(0, len(text)), random.choice(BAD) + random.choice(["", "s", "ing", "!"]))
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, helpers.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("seed", range(4))
def test_block_max_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    n, terms = int(rng.integers(1, 300)), 40
    dense = np.where(rng.random((n, terms)) < 0.15, rng.random((n, terms)), 0)
    dense[::7] = dense[0]  # ties
    dense = dense[(dense > 0).any(axis=1)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    index = Index.build(terms, [(np.flatnonzero(v), v[v > 0]) for v in dense], np.ones((len(dense), 2)), np.arange(len(dense)))
    stored = dense[index.doc_ids]
    for _ in range(40):
        query = np.where(rng.random(terms) < 0.2, rng.random(terms), 0)
        if not query.any():
            continue
        query /= np.linalg.norm(query)
        got = index.search([(np.flatnonzero(query), query[query > 0])], 10)[0]
        want = np.sort(stored @ query)[::-1]
        assert np.allclose([s for s, _ in got], want[want > 0][:10])
        assert np.allclose([stored[r] @ query for _, r in got], [s for s, _ in got])


def test_empty_index():
    assert Index.build(3, [], np.zeros((0, 2)), np.zeros(0)).search([(np.array([1]), np.array([1.0]))], 5) == [[]]


def test_held_out_accuracy_and_fold(spark):
    docs, labels = table(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 600
    held = [r for r in got.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    bad = next(r for r in held if r["predicted"])
    assert bad["evidence"][0]["cosine"] > 0.9 and bad["evidence"][0]["toxic_share"] == 1.0


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = table(spark)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}


def test_edges(spark):
    docs = helpers.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (6, 1, None), (6, 1, 0), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        got = toxicity.toxicity(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(helpers.empty(spark), odd).count() == 0
    kept = toxicity.without_toxic(*table(spark))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 440 < kept.count() < 500


def test_copy_of_an_example_is_found_by_any_of_its_words(spark):
    """Too few labels for any single term to tell them apart."""
    random.seed(1)
    texts = [" ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(40)) for _ in range(40)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    known = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    bad = set(known[::6])
    rows += [(1000 + i, texts[i].upper(), "en", "s", 0) for i in known]
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in known], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    for i in known:
        near = got[1000 + i]["evidence"][0]
        assert near["doc_id"] == i and near["cosine"] > 0.999 and near["toxic_share"] == (i in bad)
    assert min(got[1000 + i]["score"] for i in bad) > max(got[1000 + i]["score"] for i in known if i not in bad)


def test_frequencies_come_from_all_documents(spark):
    docs = spark.createDataFrame([(i, "rare usual" if i == 1 else "usual", "en", "s", 0) for i in range(50)], helpers.SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    _, weights = toxicity.Vectorizer(toxicity.fit(docs, labels).idf)(["rare usual"])[0]
    assert sorted(weights / min(weights)) == pytest.approx([1, np.log(51 / 2) + 1])


def test_grams_of_joined_words_are_those_of_each():
    words = ["ab", "abcdef", "xabcde", "b", "éabcd", "cdefg", "abcde"]
    grams = ["^abcd", "cdef$", "^b$", "éabcd", "abcde"]
    terms = toxicity.Terms(np.zeros(0, np.uint64), grams, np.ones(len(grams)))
    want = {w.encode(): sorted(i for i, g in enumerate(grams) if g in toxicity.word_terms(w)) for w in words}
    assert terms.grams_of([w.encode() for w in words]) == {w: x for w, x in want.items() if x}


def test_places_survive_forgetting(monkeypatch):
    monkeypatch.setattr(toxicity, "WORD_CACHE", 5)
    random.seed(2)
    words = [f"w{i}" for i in range(40)]
    keys = np.sort(np.array([toxicity.word_key(w.encode()) for w in words[:25]], np.uint64))
    terms = toxicity.Terms(keys, ["^w1$", "^w13$"], np.arange(1.0, 28))
    vectorize = toxicity.Vectorizer(terms)
    for _ in range(60):
        text = " ".join(random.choices(words, k=9))
        fresh = toxicity.Vectorizer(terms)([text])[0]
        kept = vectorize([text, "w1 w13"])[0]
        assert (kept[0] == fresh[0]).all() and np.allclose(kept[1], fresh[1])


def test_an_index_has_its_postings_by_term_and_ships_whole():
    rng = np.random.default_rng(5)
    dense = np.where(rng.random((90, 30)) < 0.2, rng.random((90, 30)).astype(np.float32), 0)
    dense[:, 0] = 1
    index = Index.build(30, [(np.flatnonzero(v), v[v > 0]) for v in dense], np.ones((90, 2)), np.arange(90))
    again = pickle.loads(pickle.dumps(index))
    for own in (index, again):
        got = np.zeros_like(dense)
        for t, (start, end) in enumerate(own.starts):
            got[own.doc_ids[own.rows[start:end]], t] = own.weights[start:end]
        assert (got == dense).all()
    assert (again.postings == index.postings).all() and (again.dense == index.dense).all() and (again.most == index.most).all()


def test_one_text_alone():
    vectorize = toxicity.Vectorizer(toxicity.Terms(np.sort(np.array([toxicity.word_key(b"a"), toxicity.word_key(b"b")], np.uint64)), [], np.ones(2)))
    for text in ("a b a c", "", None):
        assert all((x == y).all() for x, y in zip(vectorize(text), vectorize([text])[0], strict=True))


def test_tasks_give_memory_back(monkeypatch):
    """A worker keeps what it has freed while its next stage runs beside the JVM, unless each task gives it back."""
    given = []
    monkeypatch.setattr(shared, "release_memory", lambda: given.append(1))
    assert [*shared.releasing(lambda batches: (x + 1 for x in batches))(iter([1, 2]))] == [2, 3] and given == [1]
    index = Index.build(2, [(np.array([0]), np.ones(1))], np.ones((1, 2)), np.arange(1))
    pickle.loads(pickle.dumps(index))
    assert given == [1, 1]
