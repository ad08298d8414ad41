"""Each stage on what its predecessor kept, held against a brute-force version of it."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import decontaminate, queries, shared, toxicity
from tests.llm.test_mixing import plain_mix
from tests.llm.test_near_dup import brute

#: Large enough for the toxicity labels to tell something.
SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = shared.read_table(spark, SF, "documents")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = shared.staged(stage(spark, docs, SF), name)
        out.append(docs.collect())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == COLUMNS
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxicity(spark, stages):
    model = toxicity.fit(shared.read_table(spark, SF, "documents"), shared.read_table(spark, SF, "labels"))
    dense = np.zeros((len(model.index.votes), len(model.idf)))
    for t in range(len(model.idf)):
        span = slice(model.index.starts[t, 0], model.index.starts[t, -1])
        dense[model.index.rows[span], t] = model.index.weights[span]
    vectorize, kept = toxicity.Vectorizer(model.idf), []
    for r in stages[0]:
        places, weights = vectorize(r["text"])
        cosines = dense[:, places] @ weights if len(places) else np.zeros(len(dense))
        order = np.lexsort((np.arange(len(dense)), -cosines))[: toxicity.NEIGHBOURS]
        if model.score([(cosines[i], i) for i in order if cosines[i] > 0]) < 0.5:
            kept.append(r)
    assert sorted(kept) == sorted(stages[1]) and len(kept) < len(stages[0])


def test_near_duplicates(stages):
    want = {d for d, (_, _, first) in brute([(r["doc_id"], r["text"]) for r in stages[1]], words=5).items() if first}
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(want) and len(want) < len(stages[1])


def test_decontamination(spark, stages):
    items = [decontaminate.normalized(r["text"]) for r in shared.read_table(spark, SF, "benchmark").collect()]
    patterns = [decontaminate.Pattern(t, int(len(t) * decontaminate.RATE)) for t in items if t]

    def leaks(r):
        return any(p.best(decontaminate.normalized(r["text"])) for p in patterns)

    kept = {r["doc_id"] for r in stages[3]}
    gone = [r for r in stages[2] if r["doc_id"] not in kept]
    assert gone and all(map(leaks, gone)) and len(stages[3]) + len(gone) == len(stages[2])
    # the full search of all kept texts takes minutes
    assert not any(map(leaks, stages[3][:100]))


def test_mixing(stages):
    sizes, _, targets = plain_mix([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in stages[3]])
    size = {r["doc_id"]: n for r, n in zip(stages[3], sizes, strict=True)}
    source = {r["doc_id"]: r["source"] for r in stages[3]}
    taken = Counter()
    copies = Counter(r["doc_id"] for r in stages[4])
    for d, n in copies.items():
        taken[source[d]] += n * size[d]
    assert max(copies.values()) <= 3
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(size[d] for d in size if source[d] == s)


def test_token_ids(stages):
    model = Tokenizer.from_file(queries.tokenizer_path())
    start, want = 0, []
    for r in sorted(stages[4], key=lambda r: (r["doc_id"], r["text"])):
        ids = [*model.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in stages[5]) == want


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("shard").collect())) == sorted(tuple(r)[:4] for r in stages[5])
