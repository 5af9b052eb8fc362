"""Stored results: content addresses, latest-wins tables, references, expiry.

Plain Parquet has no MERGE, so a table's change is a new version of it: union
and the latest row of each key. Files are written by Spark's commit protocol,
which makes a write atomic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of both, the latest of each key. By one aggregation, so a hot key is summed on the map side."""
    both = old.unionByName(new)
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), F.struct(*order)).alias("row"))
    return latest.select("row.*")


def by_content(df: DataFrame, content: Column, id_col: str, size: str) -> DataFrame:
    """One row for each distinct content: its address, first id, copies and size."""
    return df.withColumn("sha", F.sha2(content, 256)).groupBy("sha").agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"), F.max(size).alias("size"))


def unreferenced(blobs: DataFrame, id_col: str, references: list[DataFrame]) -> DataFrame:
    """Blobs that no table refers to."""
    used = reduce(DataFrame.unionAll, (r.toDF("_ref") for r in references)).distinct()
    return blobs.join(used, F.col(id_col) == F.col("_ref"), "left_anti")


def expired(rows: DataFrame, clock: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Adds ``expired``: older than so long before the clock table's latest time (one row, joined by broadcast)."""
    now = clock.agg(F.max(ts).alias("_now"))
    return rows.join(F.broadcast(now), how="cross").withColumn("expired", F.col(ts) < F.col("_now") - F.expr(f"INTERVAL {seconds} SECONDS")).drop("_now")


def sealed(df: DataFrame, result: str) -> DataFrame:
    """Adds the checksum of a result document."""
    return df.withColumn("sha", F.sha2(F.to_json(result), 256))


def verified(df: DataFrame, result: str, status: str) -> DataFrame:
    """On reading: a document that isn't what its checksum says makes its job failed."""
    return df.withColumn(status, F.when(F.col("sha") == F.sha2(F.to_json(result), 256), F.col(status)).otherwise("failed"))


def admit(jobs: DataFrame, requests: DataFrame, key: str, created: str, pending: int = 4) -> DataFrame:
    """Requests with their fate: ``reused`` (same content is known or asked for before), ``refused`` or ``queued``.

    Only as many requests as may be pending are ever put in order, whatever comes in.
    """
    known = requests.join(jobs.where(F.col("status").isin("queued", "running", "succeeded")).select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    first = F.row_number().over(Window.partitionBy(key).orderBy(created)) == 1
    marked = known.withColumn("_new", first & F.col("_known").isNull())
    busy = jobs.where(F.col("status").isin("queued", "running")).agg(F.count("*").alias("_busy"))
    ahead = marked.where("_new").select(key, created).orderBy(created, key).limit(pending)
    place = F.row_number().over(Window.orderBy(created, key))
    taken = ahead.withColumn("_place", place).join(F.broadcast(busy), how="cross").where(F.col("_busy") + F.col("_place") <= pending).select(key, F.lit(True).alias("_taken"))
    seen = marked.join(taken, key, "left")
    return seen.withColumn("fate", F.when(~F.col("_new"), "reused").when(F.col("_taken"), "queued").otherwise("refused")).drop("_known", "_new", "_taken")


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart, what was under way has failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def newest(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The newest so many rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_r") <= most).drop("_r")


def export(user: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """One document a user: their row, and their rows of each table. A user's rows are bounded by quotas."""
    out = user
    for name, t in tables.items():
        out = out.join(t.groupBy(key).agg(F.collect_list(F.struct(*(c for c in t.columns if c != key))).alias(name)), key, "left")
    return out.select(key, F.to_json(F.struct(*(c for c in out.columns if c != key))).alias("document"))


def erased(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A table without the rows of some users."""
    return df.join(gone.select(key).distinct(), key, "left_anti")
