"""Operators that fold or align, against direct transcriptions of their rules."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import aggregates as A
from tidemark.operators import alignment as L
from tidemark.operators import matching as M
from tidemark.operators import pairing as P
from tidemark.operators import quality as Q
from tidemark.operators import store as S
from tidemark.operators import windows as W
from tidemark.streaming import stateful as ST


def one(spark, column, **values):
    kinds = {int: "long", float: "double", str: "string", bool: "boolean", type(None): "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("out")).first()["out"]


def test_classes_follow_their_order(spark):
    status = lambda c: one(spark, X.classify_deviation(F.col("c")), c=c)
    cases = {None: "uncertain", 25.0: "correct", 25.1: "sharp", -25.1: "flat", 1200.0: "octave", -1120.0: "octave", 1119.0: "sharp", 1281.0: "outlier", 0.0: "correct"}
    assert {c: status(c) for c in cases} == cases
    assert one(spark, X.classify_timing(F.col("m")), m=80.0) == "correct" and one(spark, X.classify_timing(F.col("m")), m=80.5) == "late"
    assert one(spark, X.merge_status(F.col("a"), F.col("b")), a="sharp", b="late") == "wrong_pitch"
    assert one(spark, X.verdict(F.col("p")), p=None) == "unchecked" and one(spark, X.verdict(F.col("p")), p=0.7) == "heard"


def test_rounding_and_scores(spark):
    assert [one(spark, X.half_even(F.col("x")), x=v) for v in (2.5, 3.5, -2.5)] == [2.0, 4.0, -2.0]
    assert [one(spark, X.half_up(F.col("x")), x=v) for v in (2.5, -2.5)] == [3.0, -2.0]
    assert one(spark, X.rhythm_score(F.col("a"), F.col("b")), a=15.0, b=30.0) == 100.0
    assert one(spark, X.rhythm_score(F.col("a"), F.col("b")), a=None, b=30.0) is None
    assert one(spark, X.clamp(F.col("x"), 0, 1), x=None) is None
    assert one(spark, X.note_name(F.col("m")), m=69) == "A4"
    assert abs(one(spark, X.midi_to_hz(X.hz_to_midi(F.col("h"))), h=523.25) - 523.25) < 1e-6


def test_mini_languages(spark):
    assert [tuple(r) for r in one(spark, X.parse_ranges(F.col("t")), t="3-5, 9,x, 7-2")] == [(3, 5), (9, 9)]
    assert one(spark, X.parse_meters(F.col("t")), t="1:4, 9:3,bad") == {1: 4, 9: 3}
    assert one(spark, X.key_of_name(F.col("t")), t="  My   Score.MusicXML") == "my score"
    assert one(spark, X.email_of(F.col("t")), t=" A@B.org ") == "a@b.org" and one(spark, X.email_of(F.col("t")), t="nope") is None
    assert one(spark, X.video_id(F.col("t")), t="https://youtu.be/abcdefghijk?t=3") == "abcdefghijk"
    assert one(spark, W.range_text(F.array(*(F.lit(i) for i in (5, 3, 4, 9, 3))))) == "3-5, 9"


def test_folds_agree_with_loops(spark):
    rng = random.Random(1)
    rows = [(u, round(rng.random() * 3, 3)) for u in range(6) for _ in range(40)]
    df = spark.createDataFrame(rows, "u int, t double")
    for u in range(6):
        ts = sorted(t for v, t in rows if v == u)
        kept, clusters = [], []
        for t in ts:
            if not kept or t > kept[-1] + 0.15:
                kept.append(t)
            if clusters and t - clusters[-1][1] <= 0.035 and t - clusters[-1][0] <= 0.09:
                clusters[-1] = (clusters[-1][0], t, clusters[-1][2] + 1)
            else:
                clusters.append((t, t, 1))
        assert sorted(r["t"] for r in W.dedupe_onsets(df, ["u"], "t", 0.15).where(f"u = {u}").collect()) == kept
        got = sorted((r["start"], r["stop"], r["n"]) for r in W.clusters(df, ["u"], "t", 0.035, 0.09).where(f"u = {u}").collect())
        assert got == clusters
    pairs = F.array(*(F.struct(F.lit(float(a)).alias("beat"), F.lit(float(b)).alias("sec")) for a, b in [(0, 0), (1, 2), (2, 1), (3, 2.0005), (4, 3)]))
    assert [r["beat"] for r in one(spark, W.increasing(pairs, 0.001))] == [0.0, 1.0, 4.0]


def test_strict_and_greedy_matching(spark):
    notes = spark.createDataFrame([(1, k, k * 1.0, 0.6) for k in range(4)], "u int, id int, ref double, dur double")
    onsets = spark.createDataFrame([(1, t) for t in (0.05, 0.15, 1.1, 2.5)], "u int, t double")
    got = [(r["id"], r["onset"], r["matched"]) for r in M.monotone_onsets(notes, onsets, ["u"]).orderBy("id").collect()]
    assert got == [(0, 0.05, True), (1, 1.1, True), (2, 2.0, False), (3, 3.0, False)]
    pairs = M.greedy_pairs(onsets, spark.createDataFrame([(1, 0.12), (1, 1.0)], "u int, t double"), ["u"], 0.2)
    assert sorted((r["left_t"], r["right_t"]) for r in pairs.collect()) == [(0.05, 0.12), (1.1, 1.0)]


def test_edit_path_agrees_with_cell_by_cell():
    rng = np.random.default_rng(2)
    for _ in range(25):
        x, y = rng.integers(60, 72, rng.integers(1, 9)).astype(float), rng.integers(60, 72, rng.integers(1, 9)).astype(float)
        n, m = len(x), len(y)
        d = np.zeros((n + 1, m + 1))
        d[:, 0], d[0] = 0.8 * np.arange(n + 1), np.arange(m + 1)
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                a = abs(x[i - 1] - y[j - 1])
                d[i, j] = min(d[i - 1, j - 1] + min(2.5, a, abs(a - 12) + 0.75), d[i - 1, j] + 0.8, d[i, j - 1] + 1.0)
        cost, pairs = L.edit_path(x, y)
        assert abs(cost - d[n, m]) < 1e-9
        assert all(a < c and b < e for (a, b), (c, e) in zip(pairs, pairs[1:]))


def test_location_refuses_what_fits_twice(spark):
    schema = "u int, k int, p double"
    phrase = [60, 62, 64, 65, 67]
    other = [72, 71, 74, 60, 75, 61, 77]
    heard = spark.createDataFrame([(u, k, float(p)) for u in (1, 2) for k, p in enumerate(phrase)], schema)
    written = spark.createDataFrame([(1, k, float(p)) for k, p in enumerate(other + phrase + other)] + [(2, k, float(p)) for k, p in enumerate(phrase + other + phrase)], schema)
    got = {r["u"]: (r["start"], r["located"]) for r in L.locate(heard, written, ["u"], "k", "p").collect()}
    assert got == {1: (7, True), 2: (None, False)}
    same = L.align(heard.where("u = 1"), heard.where("u = 1"), ["u"], "k", "p").collect()
    assert [(r["heard_seq"], r["written_seq"]) for r in sorted(same, key=lambda r: r["heard_seq"])] == [(i, i) for i in range(5)]


def test_sequence_measures(spark):
    a, b = list("abcbdab"), list("bdcaba")
    assert one(spark, L.lcs_length(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))) == 4
    assert L.dtw_cost([[1, 2], [3]], [[1, 2], [3]]) == 0 and abs(L.dtw_cost([[1], [2]], [[1]]) - 0.3) < 1e-9
    shifts = np.array([-0.5, 0.0, 0.5])
    assert L.shift_path(np.array([[1, 0, 1], [1, 0.2, 0.1], [1, 0, 1.0]]), shifts, 1.0).tolist() == [0.0, 0.0, 0.0]
    assert L.dice_path(np.array([[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])) == [(0, 0), (1, 2)]


def test_null_is_not_zero(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (2, 30.0, 1.0), (2, None, 1.0)], "k int, d double, w double")
    got = {r["k"]: r["score"] for r in A.weighted_capped_score(df, ["k"], "d", "w").collect()}
    assert got == {1: None, 2: None}
    assert not Q.verdict(verdict_rows(spark, [{"notes": 20, "scored": 5}])).first()["overall"]


VERDICT = "notes long, scored long, correct long, voiced long, timing_candidates long, timed long, outliers long, octaves long, excluded long, pitch double, rhythm double, reasons array<string>, unaligned boolean, degraded boolean, clipped boolean, unsure boolean, tempo_mismatch boolean, refused boolean, beyond_score boolean, rescued boolean, range_rescue boolean"


def verdict_rows(spark, rows):
    names = [c.split()[0] for c in VERDICT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], VERDICT)


def test_verdict_follows_from_the_evidence(spark):
    good = {"notes": 100, "scored": 90, "correct": 80, "voiced": 95, "timing_candidates": 99, "timed": 95, "pitch": 90.0, "rhythm": 81.0}
    cases = [
        (good, "complete", 86.0, "full", []),
        (good | {"rescued": True}, "complete_with_rescue", 86.0, "full", []),
        (good | {"scored": 55, "correct": 50}, "partial", 86.0, "reference", ["low_coverage"]),
        (good | {"scored": 40, "correct": 12}, "score_audio_mismatch", None, None, ["low_coverage", "score_audio_mismatch"]),
        (good | {"correct": 20}, "complete", 86.0, "full", []),  # many wrong notes on a verified timeline
        (good | {"outliers": 10, "octaves": 9}, "partial", None, None, ["pitch_tracking_unreliable"]),
        (good | {"tempo_mismatch": True, "rhythm": 59.0}, "partial", None, None, ["tempo_mismatch", "tempo_timing_unreliable"]),
        (good | {"pitch": None, "rhythm": None, "refused": True}, "score_unreliable", None, None, ["score_unreliable"]),
        (good | {"pitch": None, "rhythm": None}, "insufficient_evidence", None, None, []),
        (good | {"degraded": True, "reasons": ["beat:rejected"]}, "complete", 86.0, "full", ["beat_grid_rejected"]),
        (good | {"degraded": True, "reasons": ["beat:rejected", "onset:builtin"]}, "complete", 86.0, "full", ["builtin_detectors", "beat_grid_rejected"]),
    ]
    for row, outcome, overall, reliability, issues in cases:
        r = Q.verdict(verdict_rows(spark, [row])).first()
        assert (r["outcome"], r["overall"], r["reliability"], r["issues"]) == (outcome, overall, reliability, issues), row


def test_store_and_states(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "id int, v string, at int")
    assert sorted(map(tuple, S.upsert(old, new, ["id"], ["at"]).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    jobs = spark.createDataFrame([("k1", "succeeded", 1), ("k2", "queued", 2)], "key string, status string, created int")
    ask = spark.createDataFrame([("k1", 3), ("k3", 4), ("k3", 5), ("k4", 6)], "key string, created int")
    fate = {r["created"]: r["fate"] for r in S.admit(jobs, ask, "key", "created", pending=2).collect()}
    assert fate == {3: "reused", 4: "queued", 5: "reused", 6: "refused"}
    assert ST.fold_states([(0, "validating"), (0, "preparing"), (0, "polling"), (1, "submitting"), (0, "cancelled"), (1, "polling"), (1, "succeeded")]) == ("succeeded", 1, 2)
    state = S.verified(S.sealed(spark.createDataFrame([(("x", 1), "done")], "r struct<a:string,b:int>, status string"), "r"), "r", "status").first()["status"]
    assert state == "done"


def test_streams_agree_with_their_batch_twins(spark, tmp_path):
    rows = [(j, s, g, a) for j in range(3) for s, (g, a) in enumerate([(0, "validating"), (0, "preparing"), (0, "submitting"), (0, "failed")][: 2 + j])]
    schema = "job int, seq int, generation long, action string"
    df = spark.createDataFrame(rows, schema)
    for k in range(2):  # two files: two batches
        df.where(f"seq % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {r["job"]: r["state"] for r in ST.job_states(df, "job", ["seq"], "generation", "action").collect()}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = ST.job_state_stream(stream, "job", "generation", "action", "seq").writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["job"]: r["state"] for r in spark.sql("SELECT * FROM states").collect()} == want


def test_sequence_queries_read_whole_sequences(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidemark.plans import more

    # 90 events of one user, one every 8 hours; the 12 from the 11th on come again from the 71st on.
    rng = random.Random(4)
    value = [float(rng.randrange(60)) for _ in range(90)]
    value[70:82] = value[10:22]
    kind = ["view"] * 40 + ["click", "view", "click", "purchase"] + ["view"] * 46
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=8 * i), 1, kind[i], value[i], None) for i in range(90)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert more.lcs_opening(spark, str(tmp_path)).first()["matched"] == 5
    found = more.locate_excerpt(spark, str(tmp_path)).first()
    assert (found["cost"], found["runner_up"], found["located"]) == (0.0, 0.0, False)
    want = set()
    for lo in range(0, 84, 21):
        cost, pairs = L.edit_path(36 + np.array(value[lo : lo + 21]), 36 + np.array(value[lo + 21 : lo + 42]))
        want |= {(lo + i, lo + 21 + j, round(cost, 3)) for i, j in pairs}
    got = more.edit_align(spark, str(tmp_path))
    assert got.columns == ["user_id", "heard_seq", "written_seq", "cost"]
    assert {tuple(r)[1:] for r in got.collect()} == want


def test_folds_of_two_sides_of_one_table(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 60), (1, 2, 2.0, 62), (2, 3, 1.0, 60)], "k int, id long, t double, midi int")
    a, b = rows.where("id <> 2"), rows.where("k = 1")
    for made in (M.greedy_pairs(a, b, ["k"], 0.5), P.same_pitch(a, b, ["k"], 0.5), L.align(a, b, ["k"], "id", "t"), M.two_stage_offset(a, b, ["k"], 1.0)):
        assert made.count() == len(made.collect())
    assert [tuple(r) for r in M.greedy_pairs(a, b, ["k"], 0.5).collect()] == [(1, 1.0, 1.0)]
    assert M.greedy_pairs(a.where("false"), b, ["k"], 0.5).count() == 0 and M.greedy_pairs(a, b.where("false"), ["k"], 0.5).count() == 0


def test_two_stage_offset_finds_the_shift(spark):
    grid = spark.createDataFrame([(1, float(k)) for k in range(12)], "k int, t double")
    heard = spark.createDataFrame([(1, k + 0.265625) for k in range(1, 10)], "k int, t double")
    r = M.two_stage_offset(grid, heard, ["k"], 1.0).first()
    assert (r["offset"], r["mean_ms"], r["within_50ms"]) == (0.2656, 0.0, 1.0)


def test_rolled_chords_and_loop_windows(spark):
    e = spark.createDataFrame([(1, 0.0, 1.0, 60.0), (1, 0.04, 0.9, 64.0), (1, 0.3, 0.8, 67.0), (1, 0.95, 1.5, 70.0), (1, 2.0, 1.0, 50.0), (1, 3.0, 3.5, 72.0)], "k int, start double, stop double, pitch double")
    got = sorted((r["start"], round(r["stop"], 3), r["pitches"]) for r in W.rolled_chords(e, ["k"]).collect())
    assert got == [(0.0, 0.949, [60.0, 64.0, 67.0]), (0.95, 1.5, [70.0]), (3.0, 3.5, [72.0])]
    bars = spark.createDataFrame([(1, 2.0 * i, b) for i, b in enumerate([1, 2, 3, 1, 2, 3, 4])], "k int, t double, bar int")
    near = lambda t: tuple(W.loop_windows(bars, ["k"], "t", "bar", F.lit(1), F.lit(2), F.lit(t)).first())[1:]
    assert near(0.5) == (0.0, 4.0) and near(4.5) == (5.85, 10.0) and near(30.0) == (0.0, 4.0)
    assert tuple(W.loop_windows(bars, ["k"], "t", "bar", F.lit(3), F.lit(4), F.lit(0.0)).first()) == (1, 3.85, 14.0)


def test_one_voice_is_a_stream_over_sorted_rows(spark):
    """Null, NaN and infinite values, null keys, ties and repeated rows, and groups that go on over batches of two rows."""

    def voice(rows):
        last = lambda x: (x is None or x != x, 0.0 if x is None else x)
        out, head = [], None
        for start, stop, pitch in sorted(rows, key=lambda r: (last(r[0]), last(r[2]))):
            start, stop, pitch = (float("nan") if x is None else x for x in (start, stop, pitch))
            if head is None or start - head > 2.0:
                head = start
                out.append([start, stop, pitch])
            elif pitch < out[-1][2]:
                out[-1][1:] = [stop, pitch]
        for a, b in zip(out, out[1:]):
            a[1] = min(a[1], b[0] - 0.001)
        return [tuple(None if x != x else x for x in r) for r in out]

    rng, nan = random.Random(5), float("nan")
    rows = []
    for key in [("a", 1), ("a", None), (None, 1), (None, None), ("b", 1), ("c", 2)]:
        for k in range(rng.choice([1, 9, 40])):
            start = rng.choice([rng.random() * 30, k / 1.0, k / 1.0, None, nan, float("inf")] if key[0] != "c" else [None])
            # The stop follows from start and pitch, so ties can't be told apart.
            pitch = rng.choice([50.0, 51.0, 52.0, None, nan])
            rows += [(*key, start, rng.choice([None, nan]) if start is None or pitch is None else start + 1.5 + pitch % 3, pitch)] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, "k string, n int, start double, stop double, pitch double")
    expected = [(*key, *v) for key in {r[:2] for r in rows} for v in voice([r[2:] for r in rows if r[:2] == key])]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        found = W.mono(df, ["k", "n"], window=2.0)
        got = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan  # no call between Spark and Python for each key
