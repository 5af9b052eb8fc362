"""Grouping of two sides: one stream of rows, cut where the key changes."""

from __future__ import annotations

import pandas as pd

from tidemark.operators import pairing as P
from tidemark.session import cogroup


def test_groups_of_two_sides_are_whole_and_exact(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go on over batches
    try:
        a = [(k, n, (1 << 60) + n if n % 3 else None) for k in [None, *range(20)] for n in range(20 if k == 3 else (k or 1) % 4)]
        b = [(k, n) for k in [None, *range(10, 30)] for n in range(3)]

        def fold(key, x, y):
            return [(key[0], len(x), len(y), sum(int(v) for v in x["big"] if pd.notna(v)) if x["big"].dtype != "float64" else -1, int(y["n"].sum()))]

        left, right = spark.createDataFrame(a, "k long, n int, big long"), spark.createDataFrame(b, "k long, n int")
        found = cogroup(left, right, ["k"], fold, "k long, a long, b long, big long, n long")
        assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
        want = set()
        for k in {r[0] for r in a} | {r[0] for r in b}:
            own, other = [r for r in a if r[0] == k], [r for r in b if r[0] == k]
            want.add((k, len(own), len(other), -1 if any(r[2] is None for r in own) else sum(r[2] for r in own), sum(r[1] for r in other)))
        assert {tuple(r) for r in found.collect()} == want
        framed = cogroup(left, right, ["k"], lambda key, x, y: pd.DataFrame([(*key, len(x))] if len(x) else [], columns=["k", "a"]), "k long, a long")
        assert {tuple(r) for r in framed.collect()} == {w[:2] for w in want if w[1]}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_pairs_of_many_small_groups_are_made_in_few_calls(spark):
    """A group of its own between Spark and Python took some 20 ms; a thousand of them now share their batches."""
    n = spark.range(3000).selectExpr("id DIV 3 AS take", "CAST(id % 3 AS INT) AS midi", "id", "CAST(id AS DOUBLE) AS t")
    found = P.same_pitch(n, n, ["take"], 1.0)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan
    assert sorted((r["note"], r["heard"]) for r in found.collect()) == [(i, i) for i in range(3000)]


def test_short_voices_are_not_joined_into_one_part(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import quality as Q

    e = spark.range(200).selectExpr("id AS m", "'a' AS voice", "0 AS at", "3 AS len", "false AS rest").unionAll(spark.range(200).selectExpr("id", "'b'", "0", "6", "false"))
    found = Q.short_voices(e, ["m"], ["voice"], "at", "len", "rest", F.lit(6))
    assert found.count() == 200
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_missed_and_extra_ids_are_not_joined_into_one_part(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.plans import catalog

    spark.range(0, 200).selectExpr("id AS o_orderkey").unionAll(spark.sql("SELECT CAST(NULL AS BIGINT)")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(100, 400).selectExpr("id % 300 AS l_orderkey").unionAll(spark.sql("SELECT CAST(NULL AS BIGINT)")).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalog.missed_and_extra(spark, str(tmp_path))
    assert sorted(((r["id"], r["kind"]) for r in found.collect()), key=str) == sorted([(None, "missed"), (None, "extra"), *((i, "extra") for i in range(200, 300))], key=str)
    assert found.where("kind = 'extra'").select(F.spark_partition_id()).distinct().count() > 1


def test_hits_of_one_cell_are_dealt_out(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.plans import more

    monkeypatch.setattr(more, "HITS", 500)
    spark.range(200).selectExpr("id AS p_partkey", "4 AS p_size", "900.0 + id AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(30).selectExpr("id AS s_suppkey", "2 AS s_nationkey", "CAST(id * 20 AS DOUBLE) AS s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    found = more.hit_test(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(p, s) for p in range(200) for s in range(30) if s <= p}
    assert found.count() == sum(min(p + 1, 30) for p in range(200))
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_sequences_of_many_small_groups_are_aligned_in_few_calls(spark):
    from tidemark.operators import alignment as L

    n = spark.range(2000).selectExpr("id DIV 4 AS take", "id AS k", "CAST(50 + id % 4 AS DOUBLE) AS p")
    found = L.align(n, n, ["take"], "k", "p")
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(i // 4, i, i, 0.0) for i in range(2000)]
    assert L.align(n, n.where("take < 0"), ["take"], "k", "p").count() == 0
