"""A training corpus in five stages, each on all that the one before kept.

Language ID drops documents without a known language; the n-gram Jaccard join
keeps one document of each group of near copies; decontamination drops
documents that hold benchmark windows; mixing brings sources to their target
shares; the last stage writes token files and returns their digest.

Documents with a null text, or without letters, go in the first stage. A null id
is a document of its own to the second stage, which keeps it; rows that share
an id go together there, and are mixed alike. Columns beside those of documents
pass through every stage but the last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, language_id, mixing, ngram_join, token_files
from tidemark.llm._shared import Scratch, materialize, table

#: SQL can't express the learned model of the first stage.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialise(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.encode(docs, added_tokens=True)


STAGES = [("language_id", identify_language), ("ngram_join", drop_near_copies), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("token_files", write_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        kept = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)  # a stage's output goes once the next one has its own
        docs = kept
    digest = materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
    scratch.drop()
    return digest
