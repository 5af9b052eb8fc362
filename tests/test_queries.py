"""Every registered query with SQL returns what DuckDB returns for it."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return float(f"{float(v):.9g}")
    return int(v) if isinstance(v, (int, np.integer)) else str(v)


def rows(frame):
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, tables, duck, name):
    got, want = QUERIES[name](spark, tables).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql_and_entry_runs(spark):
    # What folds or aligns has no SQL; test_operators holds it against its rules.
    assert set(QUERIES) - set(ORACLES) == {"edit_align", "locate_excerpt", "excerpt_alignment", "take_alignment", "dtw_documents", "outlier_anchors", "two_stage_offset", "same_pitch_pairs", "wrong_note_pairs", "octave_pairs"}
    for name in set(QUERIES) - set(ORACLES):
        found = QUERIES[name](spark, "/root/testdata/sf0.001")
        # A count prunes all columns: folds of two sides of one table must still see theirs.
        assert found.count() == len(found.collect()) > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


def test_whole_queries_leave_out_no_row(spark, tables, duck):
    n = duck.sql("SELECT count(l_shipdate) FROM lineitem").fetchall()[0][0]
    assert QUERIES["point_in_interval"](spark, tables).count() == n
    parts = duck.sql("SELECT count(DISTINCT l_partkey) FROM lineitem").fetchall()[0][0]
    assert QUERIES["candidate_cutoff"](spark, tables).select("l_partkey").distinct().count() == parts
