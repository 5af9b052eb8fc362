"""The registered queries of this subpackage: thin, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversations, decontaminate, language_id, license_scan, mixing, ngram_join, quality_knn, resampling, secret_scan, sql, substring_dedup, syncmers, token_files
from ._shared import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_knn.train(docs, table(spark, sf_dir, "labels"))
    found = quality_knn.score(docs, model)
    return found.select("doc_id", quality_knn.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_knn.THRESHOLD).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode(table(spark, sf_dir, "documents"), added_tokens=True)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", "template_labels")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = (secret_scan.count_of(F.col("base"), kind[0]).alias(f"n_{kind[0]}") for kind in secret_scan.KINDS)
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(every).alias("spans"))


def op11_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damage(rows), rows).drop("rows")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_decontamination, op3_substring_dedup, op4_quality, op5_mixing, op6_ann, op7_token_files, op8_ngram_join, op9_license_scan, op10_secret_scan, op11_syncmers, op12_resampling, op13_conversations)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Of op1, op4, op6, op7 and op11 no SQL can give the rows: they hold what was learned, found, encoded or hashed."""
    fits = [(" AND ".join(f"regexp_matches(s, '{p}')" for p in (c.only, *c.needs)), c.bits) for c in secret_scan.CLASSES]
    return {
        "op2_decontamination": sql.DECONTAMINATION,
        "op3_substring_dedup": sql.SUBSTRING_DEDUP,
        "op5_mixing": sql.mixing_sql(mixing.WEIGHTS, mixing.MOST, mixing.SEED),
        "op8_ngram_join": sql.NGRAM_JOIN,
        "op9_license_scan": sql.license_sql(license_scan.PHRASES, license_scan.template_sets(license_scan.TEMPLATES)),
        "op12_resampling": sql.RESAMPLING,
        "op13_conversations": sql.CONVERSATIONS,
        "op10_secret_scan": sql.secret_sql(secret_scan.KINDS, secret_scan.CANDIDATE, secret_scan.WINDOW, fits, secret_scan.ALLOWED, secret_scan.PARTS, secret_scan.WORD),
    }
