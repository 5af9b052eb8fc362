"""Making the package importable where Spark's Python workers run."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOT = str(Path(__file__).resolve().parents[1])


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, have]) if have else _ROOT
    if _ROOT not in sys.path:
        sys.path.insert(0, _ROOT)


def parts(spark: SparkSession) -> int:
    """How many parts rows are dealt out to where Spark's own choice won't do.

    Spark joins small parts by their packed bytes. Where the work or the memory of
    a part isn't in its bytes, a task would get far too much of it; a number that
    is asked for stays.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt out by keys to as many ``parts``, by a hash of their own: Spark would drop an exchange that repeats one by the keys."""
    return rows.repartition(parts(rows.sparkSession), F.xxhash64(*keys))


def cogroup(left: DataFrame, right: DataFrame, keys: list[str], fold: Callable, schema: T.StructType | str) -> DataFrame:
    """``fold(key, left rows, right rows)`` of each key (of plain types) on either side: two pandas frames in, a frame or a list of tuples out.

    Both sides go through one exchange and one sort, as rows of one table, and a
    task reads them as a stream: batches are cut where the key changes, and only
    the group that goes on is held. A small group so costs what its fold does,
    not a call of its own between Spark and Python.
    """
    ready(left.sparkSession)
    sides = [[c for c in side.columns if c not in keys] for side in (left, right)]
    spec = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    named = [[F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)], [F.col(f"`{c}`").alias(f"_l{n}") for n, c in enumerate(sides[0])], [F.col(f"`{c}`").alias(f"_r{n}") for n, c in enumerate(sides[1])]]
    both = left.select(*named[0], F.lit(False).alias("_right"), *named[1]).unionByName(right.select(*named[0], F.lit(True).alias("_right"), *named[2]), allowMissingColumns=True)
    order = [f"_k{n}" for n in range(len(keys))]
    orders = [list(left.columns), list(right.columns)]
    return dealt(both, order).sortWithinPartitions(*order).mapInArrow(_folded(keys, sides, orders, fold, spec), spec)


def _folded(keys: list[str], sides: list[list[str]], orders: list[list[str]], fold: Callable, spec: T.StructType) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(spec)

        def begins(rows: pa.Table) -> np.ndarray:
            """Rows whose key differs from the row before."""
            new = np.zeros(len(rows), dtype=bool)
            for n in range(len(keys)):
                codes = rows.column(f"_k{n}").combine_chunks().dictionary_encode(null_encoding="encode")
                codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            return new

        def frames(rows: pa.Table, group: np.ndarray, right: bool) -> tuple[pd.DataFrame, np.ndarray, list[str]]:
            """One side's rows, where each group's begin, and its columns of whole numbers with nulls."""
            own = rows.column("_right").to_numpy() == right
            held = rows.filter(pa.array(own))
            names = {k: f"_k{n}" for n, k in enumerate(keys)} | {c: f"_{'lr'[right]}{n}" for n, c in enumerate(sides[right])}
            held = pa.table({c: held.column(names[c]) for c in orders[right]})
            # Numbers of a column with nulls stay exact; each group is given the type that its own rows call for.
            mixed = [f.name for f in held.schema if pa.types.is_integer(f.type) and held.column(f.name).null_count]
            return held.to_pandas(integer_object_nulls=True), np.searchsorted(group[own], np.arange(group[-1] + 2)), mixed

        def typed(part: pd.DataFrame, mixed: list[str]) -> pd.DataFrame:
            return part.astype({c: "float64" if part[c].isna().any() else "int64" for c in mixed}) if mixed else part

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            new = begins(rows)
            group = np.cumsum(new)
            (a, a_at, a_mixed), (b, b_at, b_mixed) = frames(rows, group, False), frames(rows, group, True)
            firsts = rows.select([f"_k{n}" for n in range(len(keys))]).take(pa.array(np.concatenate([[0], np.flatnonzero(new)])))
            made, tuples = [], []
            for g, key in enumerate(zip(*(c.to_pylist() for c in firsts.columns))):
                found = fold(key, typed(a.iloc[a_at[g] : a_at[g + 1]], a_mixed), typed(b.iloc[b_at[g] : b_at[g + 1]], b_mixed))
                if not isinstance(found, pd.DataFrame):
                    tuples += found
                elif len(found):
                    made.append(found)
            if tuples:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type, from_pandas=True) for c, f in zip(zip(*tuples), target)], schema=target)
            if made:
                whole = pd.concat(made, ignore_index=True) if len(made) > 1 else made[0]
                yield from pa.Table.from_pandas(whole[target.names], schema=target, preserve_index=False).to_batches()

        held: list[pa.Table] = []  # rows of the group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            joined = pa.concat_tables([held[-1].slice(len(held[-1]) - 1), now]) if held else now
            cuts = np.flatnonzero(begins(joined)) - bool(held)
            if not len(cuts):
                held.append(now)
                continue
            yield from done(pa.concat_tables([*held, now.slice(0, int(cuts[-1]))]))
            held = [now.slice(int(cuts[-1]))]
        if held:
            yield from done(pa.concat_tables(held))

    return run
