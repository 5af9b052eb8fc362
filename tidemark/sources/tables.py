"""The driver's tables, with the derived columns that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table, read through Spark alone; only the columns asked for are scanned."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return found.select(*columns) if columns else found


def seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp without time zone, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def days(ts: Column) -> Column:
    """Days since the epoch."""
    return F.unix_date(ts.cast("date"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``t`` (seconds) and ``day`` (number)."""
    e = load(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return e.withColumns({"t": seconds(F.col("ts")), "day": days(F.col("ts"))})
