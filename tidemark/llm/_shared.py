"""Shared plumbing: the cluster-visible scratch folder and small helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session

#: Word characters of the ``ascii words`` definition, as a Java/RE2 class.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words are maximal runs without space, tab, line feed, VT, FF and CR.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes that a worker gets at once: texts are long rows.
BATCH_ROWS, BATCH_BYTES = 1500, 8 << 20


def ready(spark: SparkSession) -> None:
    """Let workers import the package, and give them texts in short batches.

    A batch is held several times over (by the executor, on its way, by the
    worker). Settings that the session has changed itself stay.
    """
    session.ready(spark)
    rows, size = (f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent, driver and executors must be one process
    (``local[...]``): then a folder under the system's temporary folder will do.
    """
    conf = spark.sparkContext.getConf()
    place = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return place.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Drop a scratch table that nothing reads any more."""
    _delete(spark, path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: the result survives lost executors, and nothing
    upstream runs again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables that an operator writes on its way, each dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """``materialize``, with the table remembered."""
        path = scratch_path(self.spark, name)
        df.write.options(**options).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((back, path))
        return back

    def drop(self, *which: DataFrame) -> None:
        """Drop these tables, or all without any named."""
        gone = [t for t in self.tables if not which or any(t[0] is w for w in which)]
        self.tables = [t for t in self.tables if t not in gone]
        for _, path in gone:
            _delete(self.spark, path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside hand Python workers at most so many rows at once: long rows in short batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    Its cleaner works when the driver's garbage collector has found that
    nothing refers to them any more; without a nudge that can take long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Values of an array that ``running`` adds up at once.
RUN_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array, all up to it combined.

    Spark copies a fold's state at each step, so a fold can't gather an array
    of any length. Here blocks are combined first, then what precedes each
    block, then what precedes a value within its block.
    """
    last = F.greatest(F.lit(0), F.floor((F.size(values) - 1) / RUN_BLOCK).cast("int"))

    def spread(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, zero, combine))
        ahead = let(sums, lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i), zero, combine)))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), ahead.alias("ahead")), lambda z: F.transform(z["part"], lambda _, j: F.aggregate(F.slice(z["part"], F.lit(1), j + 1), z["ahead"], combine))))

    return let(values, lambda v: let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * RUN_BLOCK + 1, F.lit(RUN_BLOCK))), spread))


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
