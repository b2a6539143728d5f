"""A training corpus from `documents`: five stages, each written as Parquet and read by the next.

1. language: rows whose language can't be told go.
2. near_duplicates: of each group of near copies, whose five-word shingles have a Jaccard similarity of 0.8 or more, the smallest doc_id stays.
3. decontaminate: documents with a benchmark passage go.
4. pii: personal data in texts becomes `[KIND]`, and n_chars follows.
5. mix: sources are mixed to target weights; a row for each copy, numbered by copy_no (copy_no_2 where documents have a copy_no).

Defined cases
* A null, empty or blank text has no language and goes in the first stage.  A null source is a source of its own; a null language or n_chars stays.
* A row without a doc_id is judged as any other, but a drop by id can't name it: the first stage drops such rows if all are rejected, the second keeps them.
* Repeated rows: of rows that share a doc_id the second stage keeps one, whichever if their texts differ.  Ties: copies go by doc_id alone.
* Very long texts are read whole by every stage.  An empty table gives an empty table with the same columns.
* Columns beyond those of documents pass through all stages, whatever their names; names that start with `_mix_` or `_dec_` are the stages' own.

The package that the stages come from is imported when they run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tickforge.llm import language

    return language.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tickforge.llm import simhash

    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tickforge.llm import decontaminate

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_documents(decontaminate.decontaminate(docs, benchmark, prefix="_dec_"), prefix="_dec_")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tickforge.llm import pii

    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tickforge.llm import mixing

    return mixing.emit(mixing.mix(docs))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("mix", mixing_stage),
]

#: Four of the stages can't be said in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written; what it wrote on the way, and the result before, are deleted then."""
    from tickforge.sources import scratch

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch.scope(spark) as kept:
            path = scratch.fresh(spark, f"pipeline-{name}")
            kept.add(path)
            docs = scratch.written(stage(spark, docs, sf_dir), name, path)
        scratch.delete(spark, before)
        before = [path]
    return docs
