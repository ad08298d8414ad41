"""Corpus pipeline: filter, deduplicate, decontaminate, mix and write documents as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, mixing, near_dup, queries, shared, token_shards, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that nearest labelled examples call toxic. Null and empty texts have the score
    of a text without known words; repeated rows share their fate; no documents give none."""
    return toxicity.without_toxic(docs, shared.read_table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, similarity 0.8. Rows without text
    or doc_id stay; of repeated rows one stays; no documents give none."""
    return near_dup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item within its edits. Rows without text stay, as do all
    without items; repeated rows share their fate."""
    return decontaminate.decontaminated(docs, shared.read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the entropy-balanced mix takes it. Rows without words add none and may go;
    null sources and languages are values of their own; no documents give none."""
    return mixing.mix(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID shards of all documents, read back. Rows without text have the end id alone; rows without
    doc_id come first; repeated rows are documents of their own; no documents give none."""
    return token_shards.token_shards(docs, queries.tokenizer_path(), queries.END_ID)


STAGES = [
    ("toxicity", clean),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_ids", tokenized),
]

#: Toxicity scores and tokenization have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; a stage's table goes when
    the next one has it read."""
    docs, before = shared.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = shared.staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            shared.drop_paths(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
