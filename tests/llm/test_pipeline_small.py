"""The pipeline on a table with few labels, small enough for a full search of what it keeps."""

import pytest

import corpus_pipeline
from sparkloom.llm import decontaminate, shared

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = shared.read_table(spark, SF, "documents")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs, _ = shared.staged(stage(spark, docs, SF), name)
        out.append(docs.collect())
    return out


def test_toxic_documents_go(spark, stages):
    toxic = {r["doc_id"] for r in shared.read_table(spark, SF, "labels").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in shared.read_table(spark, SF, "labels").where("toxic = 0").collect()} - toxic
    before, after = ({r["doc_id"] for r in s} for s in stages[:2])
    assert len(toxic & (before - after)) >= 0.8 * len(toxic & before)
    assert len(clean & (before - after)) <= 0.05 * len(clean & before)


def test_no_kept_document_holds_an_item(spark, stages):
    """A search apart from the automaton, over all documents that decontamination keeps."""
    items = {decontaminate.normalized(r["text"]) for r in shared.read_table(spark, SF, "benchmark").collect()} - {""}
    patterns = [decontaminate.Pattern(t, int(len(t) * decontaminate.RATE)) for t in items]

    def leaks(r):
        text = decontaminate.normalized(r["text"])
        return any(p.best(text) for p in patterns)

    kept = {r["doc_id"] for r in stages[3]}
    gone = [r for r in stages[2] if r["doc_id"] not in kept]
    assert gone and all(map(leaks, gone)) and len(stages[3]) + len(gone) == len(stages[2])
    assert not any(map(leaks, stages[3]))
