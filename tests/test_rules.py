"""Rules over takes and readings against plain transcriptions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.operators import aggregates as A
from tidemark.operators import alignment as L
from tidemark.operators import matching as M
from tidemark.operators import pairing as P
from tidemark.operators import performance as R
from tidemark.operators import quality as Q


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def dense(items, gap, least=4):
    runs, now = [], []
    for x in sorted(items):
        if now and x[0] - now[-1][0] > gap:
            runs.append(now)
            now = []
        now.append(x)
    return [r for r in [*runs, now] if len(r) >= least and len({m for m, *_ in r}) > 1]


def test_systematic_conflicts_agree_with_loops(spark):
    rng = random.Random(1)
    notes = [(1, i, rng.choice([60, 61, 72, 67]), i // 3) for i in range(240)]
    wrong = [(1, i, m, b, m + (1 if m % 12 == 0 and not 40 < b < 52 else rng.choice([-2, 3]))) for _, i, m, b in notes if rng.random() < (0.85 if m % 12 == 0 and b % 30 < 20 else 0.1)]
    got = {(r["pitch_class"], r["apart"], r["first"], r["last"], r["n"], r["written"]) for r in Q.systematic_runs(frame(spark, wrong, "u int, id int, midi int, measure int, played int"), frame(spark, [(u, m, b) for u, _, m, b in notes], "u int, midi int, measure int"), ["u"]).collect()}
    want = set()
    for pc, apart in {(m % 12, p - m) for _, _, m, _, p in wrong}:
        for run in dense([(b, m) for _, _, m, b, p in wrong if (m % 12, p - m) == (pc, apart)], 8):
            a, z, own = run[0][0], run[-1][0], {m for _, m in run}
            written = sum(m in own and a <= b <= z for _, _, m, b in notes)
            if len(run) >= 0.7 * written:
                want.add((pc, apart, a, z, len(run), written))
    assert got == want and want


def test_octaves_added_tones_and_duplicates(spark):
    pairs = [(1, k, 100 + k, m, 12) for k, m in enumerate([1, 2, 2, 5, 30, 31])] + [(1, 50 + k, 200 + k, 3, -12) for k in range(6)]
    got = sorted((r["note"], r["first"], r["last"], r["n"]) for r in Q.octave_shifts(frame(spark, pairs, "u int, note int, heard int, measure int, apart int"), ["u"]).collect())
    assert got == [(k, 1, 5, 4) for k in range(4)]  # six in one measure are no pattern
    extras = [(1, k, 70, k * 2.0 + 0.03) for k in range(6)] + [(1, 9, 70, 3.0), (1, 10, 71, 0.0), (1, 11, 70, 99.0)]
    chords = [(1, k * 2.0) for k in range(6)] + [(1, 99.0)]
    measures = [(1, m, m * 4.0, m * 4.0 + 4.0) for m in range(3)]
    found = Q.added_tones(frame(spark, extras, "u int, id int, midi int, t double"), frame(spark, chords, "u int, t double"), frame(spark, measures, "u int, measure int, start double, stop double"), ["u"])
    assert sorted((r["id"], r["measure"], r["n"]) for r in found.collect()) == [(k, k // 2, 6) for k in range(6)]
    rng = random.Random(2)
    notes = [(1, i, rng.choice([1, 2]), rng.choice([60, 62]), rng.choice(["a", "b"]), rng.choice([0.0, 0.5, 1.0, 1.75]) + 3 * (i // 8), rng.random() < 0.5) for i in range(80)]
    got = {r["id"] for r in Q.voice_duplicates(frame(spark, notes, "u int, id int, staff int, midi int, voice string, beat double, matched boolean"), ["u"]).collect()}
    assert got == {n[1] for n in notes if not n[6] and any(o[6] and o[2:4] == n[2:4] and o[4] != n[4] and 0 < abs(o[5] - n[5]) <= 1 for o in notes)} and got


def test_timing_is_refused_without_coverage(spark):
    rows = [(1, float(e), False) for e in (5, -3, 4, 10)] + [(1, None, False)] * 2 + [(2, 1.0, False)] * 3 + [(2, None, False)] * 5 + [(3, 2.0, True)] * 9 + [(4, 1.0, False)] * 2
    got = {r["u"]: r for r in A.struck_timing(frame(spark, rows, "u int, e double, no boolean"), ["u"], "e", refused="no").collect()}
    assert got[1]["offset"] == 4.0 and got[1]["score"] is not None  # 4 of 5
    assert [(got[u]["n"], got[u]["score"], got[u]["offset"]) for u in (2, 3, 4)] == [(3, None, None), (9, None, None), (2, None, None)]


def test_rolled_chords_are_left_out_and_uneven_measures_listed(spark):
    rows = []
    for k in range(30):
        wide = 0.08 if k % 2 else 0.01
        rows += [(1, k, k * 1.0, 1, k % 30 == 3, k // 3), (1, k, k * 1.0 + wide, 2, False, k // 3)]
    got = A.chord_spreads(frame(spark, rows, "u int, c int, t double, s int, roll boolean, m int"), ["u"], "c", "t", "s", rolled="roll", measure="m").first()
    assert (got["chords"], got["uneven"]) == (29, 14)
    count = Counter(k // 3 for k in range(30) if k % 2 and k != 3)
    assert got["measures"] == sorted(count, key=lambda m: (-count[m], m))[:8]
    even = A.chord_spreads(frame(spark, rows[:2], "u int, c int, t double, s int, roll boolean, m int"), ["u"], "c", "t", "s", measure="m").first()
    assert even["measures"] == []


def onsets_truth(notes, onsets, wide):
    out, last, before = {}, -1e9, None
    for i, ref, dur in sorted(notes, key=lambda n: (n[1], n[0])):
        tries = [(min(0.22, 0.35 * dur),) * 2] + ([(min(0.4, 0.45 * (before or dur)), min(0.4, 0.45 * dur))] if wide else [])
        before, hit = dur, None
        for early, late in tries:
            near = [t for t in onsets if t > last + (0.05 if last > -1e8 else 0) and ref - early <= t <= ref + late]
            if near:
                hit = min(near, key=lambda t: (abs(t - ref), t))
                break
        if hit is not None:
            last = hit
        out[i] = (ref, False) if hit is None else (hit, True)
    return out


@pytest.mark.parametrize("wide", [None, (0.4, 0.45)])
def test_onsets_with_a_wide_window(spark, wide):
    rng = np.random.default_rng(3)
    notes = [(i, round(float(i * 0.5 + rng.normal(0, 0.05)), 3), float(rng.choice([0.25, 0.5, 1.0]))) for i in range(60)]
    times = sorted(round(float(t), 3) for t in rng.uniform(0, 30, 55))
    got = {r["id"]: (r["onset"], r["matched"]) for r in M.monotone_onsets(frame(spark, [(1, *n) for n in notes], "u int, id int, ref double, dur double"), frame(spark, [(1, t) for t in times], "u int, t double"), ["u"], apart=0.05, wide=wide).collect()}
    assert got == onsets_truth(notes, times, wide)


def test_lead_ins(spark):
    opening = [60, 64, 67, 72, 71, 69, 65, 62, 59, 55, 57, 60]
    tuning = [(k * 0.8, 57.0 if k % 2 else 50.0) for k in range(10)]
    takes = {1: tuning + [(9 + k * 0.5, float(p)) for k, p in enumerate(opening)], 2: [(k * 0.5, float(p)) for k, p in enumerate(opening + [60, 62, 64])], 3: [(k * 0.5, 40.0) for k in range(30)], 4: [(0.0, 50.0), (0.5, 57.0)] + [(1.0 + k * 0.5, float(p)) for k, p in enumerate(opening)], 5: tuning[:3]}
    takes[6] = [(t + (70 if k >= 10 else 0), p) for k, (t, p) in enumerate(takes[1])]
    heard = frame(spark, [(u, float(t), p) for u, x in takes.items() for t, p in x], "u int, t double, pitch double")
    notes = frame(spark, [(u, k, float(p)) for u in takes for k, p in enumerate(opening)], "u int, k int, pitch double")
    assert {r["u"]: r["start"] for r in L.lead_ins(heard, notes, ["u"]).collect()} == {1: 9.0, 2: None, 3: None, 4: None, 5: None, 6: None}
    rng = np.random.default_rng(4)
    for _ in range(30):
        windows, head = rng.integers(0, 6, (5, 7)).astype(float), rng.integers(0, 6, 4).astype(float)
        want = []
        for w in windows:
            best = [[0] * 5 for _ in range(8)]
            for i, x in enumerate(w):
                for j, y in enumerate(head):
                    best[i + 1][j + 1] = best[i][j] + 1 if abs(x - y) <= 1 else max(best[i][j + 1], best[i + 1][j])
            want.append(best[-1][-1] / 4)
        assert L._shares(windows, head).tolist() == want


def pairs_truth(a, b):
    def f1(x, y):
        x, y = Counter(x), Counter(y)
        return 1.0 if not x and not y else 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))

    n, m = len(a), len(b)
    cost = [[0.0] * (m + 1)] + [[float("inf")] * (m + 1) for _ in range(n)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1], cost[i - 1][j] + 0.3, cost[i][j - 1] + 0.3) + 1 - f1(a[i - 1], b[j - 1])
    return min(cost[n][1:])


def test_readings_are_compared_measure_by_measure(spark):
    rng = random.Random(5)
    for _ in range(40):
        a, b = ([[rng.choice([60, 62, 64]) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 6))] for _ in range(2))
        bags = [[dict(Counter(x)) for x in side] for side in (a, b)]
        sim = L._likeness(*bags)
        pairs = L.measure_pairs(sim)
        path = sorted((i, j) for i, js in pairs.items() for j in js)
        assert [i for i in range(len(a)) if i not in pairs] == []
        total = sum(1 - sim[i, j] for i, j in path) + 0.3 * sum((i == k) + (j == q) for (i, j), (k, q) in zip(path, path[1:]))
        assert abs(total - pairs_truth(a, b)) < 1e-9
    bars = [[60, 64], [62, 65], [67, 71], [72, 60]]
    one = [(1, m, p, float(k)) for m, x in enumerate(bars, 1) for k, p in enumerate(x)]
    # a title's residue ahead, a measure split in two, a key misread
    two = [(1, 1, 30, 0.0), (1, 2, 60, 0.0), (1, 2, 64, 1.0), (1, 3, 62, 0.0), (1, 4, 65, 1.0), (1, 5, 67, 0.0), (1, 5, 70, 1.0), (1, 6, 72, 0.0), (1, 6, 60, 1.5)]
    schema = "u int, measure int, midi int, at double"
    got = {r["measure"]: (r["paired"], r["pitch"], r["onset"]) for r in L.compared_readings(frame(spark, one, schema), frame(spark, two, schema), ["u"]).collect()}
    assert got == {1: ([2], 1.0, 1.0), 2: ([3, 4], 1.0, 1.0), 3: ([5], 0.5, 0.5), 4: ([6], 1.0, 0.5)}


def test_older_results_have_defaults(spark):
    names = "notes long, scored long, correct long, voiced long, timing_candidates long, timed long, outliers long, octaves long, excluded long, pitch double, rhythm double, reasons array<string>, unaligned boolean, degraded boolean, clipped boolean, unsure boolean, tempo_mismatch boolean, refused boolean, beyond_score boolean, rescued boolean, range_rescue boolean, timeline boolean"
    fields = [c.split()[0] for c in names.split(", ")]
    row = lambda **k: tuple(k.get(f) for f in fields)
    old = {"notes": 20, "voiced": 18, "timed": 19, "correct": 5, "pitch": 90.0, "rhythm": 80.0, "timeline": True}
    got = Q.verdict(frame(spark, [row(**old), row(**old, unsure=True), row(**old, unaligned=True), row(**(old | {"timeline": None})), row(**(old | {"scored": 20, "pitch": None}))], names)).collect()
    assert (got[0]["pitch_coverage"], got[0]["timing_coverage"], got[0]["match_rate"], got[0]["outcome"]) == (0.9, 1.0, None, "complete")
    assert [r["follow_ready"] for r in got] == [True, False, False, False, False]
    assert got[4]["outcome"] == "score_audio_mismatch"


def shifts_truth(notes, frames, change):
    """The best sequence of shifts, by plain loops."""
    shifts = [round(k * 0.03, 6) for k in range(-25, 26)]
    bars = sorted({m for m, *_ in notes})
    gain = {m: [0.0] * len(shifts) for m in bars}
    for m, p, a, z in notes:
        for k, s in enumerate(shifts):
            inside = [q for t, q in frames if a + s <= t < z + s]
            gain[m][k] += sum(abs(q - p) < 0.35 for q in inside) / len(inside) if len(inside) >= 2 else 0.0
    best = [(g, [k]) for k, g in enumerate(gain[bars[0]])]
    for m in bars[1:]:
        after = []
        for k, s in enumerate(shifts):
            value, way = max(((v - change / 0.1 * abs(shifts[j] - s), way) for j, (v, way) in enumerate(best)), key=lambda c: c[0])
            after.append((value + gain[m][k], [*way, k]))
        best = after
    total, way = max(best, key=lambda c: c[0])
    return total, [shifts[k] for k in way], sum(gain[m][25] for m in bars)


def test_measures_of_a_drifting_grid_are_shifted(spark):
    rng = np.random.default_rng(6)
    notes = [(1 + k // 4, 60 + (k * 5) % 12, 0.5 * k, 0.5 * k + 0.5) for k in range(48)]
    late = lambda t: t + (0.0 if t < 6 else 0.45 * min(1.0, (t - 6) / 10))
    frames = [(round(float(t), 4), float(next((p for _, p, a, z in notes if late(a) <= t < late(z)), 40) + rng.normal(0, 0.05))) for t in np.arange(0, 25.0, 0.04)]
    edges = [(m, 2.0 * (m - 1)) for m in range(1, 14)]
    df = lambda rows, schema: frame(spark, [(u, *r) for u in (1, 2) for r in rows], schema)
    steady = [(t, float(next((p for _, p, a, z in notes if a <= t < z), 40))) for t, _ in frames]
    heard = frame(spark, [(1, *f) for f in frames] + [(2, *f) for f in steady], "u int, t double, midi double")
    got: dict = {}
    for r in R.shifted_measures(df(notes, "u int, measure int, midi int, start double, stop double"), heard, df(edges, "u int, measure int, t double"), ["u"]).collect():
        got.setdefault(r["u"], []).append((r["measure"], r["t"], r["shift"]))
    total, way, flat = shifts_truth(notes, frames, R.CHANGE)
    assert set(got) == {1} and total > flat
    rows = sorted(got[1])
    assert [m for m, *_ in rows] == list(range(1, 14)) and [s for *_, s in rows] == [*way, way[-1]]
    assert all(t == round(2.0 * (m - 1) + s, 3) for m, t, s in rows) and rows[-1][2] > 0.15 and rows[0][2] == 0.0


def test_voices_are_placed_row_by_row(spark):
    rows = [(1, [1.0, 1.0], 4.0, [0.0, 2.0]), (2, [3.0, 2.0], 4.0, []), (3, [1.0], 4.0, None)]
    got = {r["k"]: r for r in P.placed_voices(frame(spark, rows, "k int, d array<double>, n double, o array<double>"), ["k"], "d", "n", "o").collect()}
    assert got[1]["onsets"] == [0.0, 2.0] and got[2]["onsets"] is None
    want = P.place_voice([1.0], 4.0, set())
    assert got[3]["onsets"] == want[0] and abs(got[3]["margin"] - want[1]) < 1e-9
    assert P.placed_voices(frame(spark, rows, "k int, d array<double>, n double, o array<double>"), ["k"], "d", "n", "o", least=99.0).where("onsets IS NOT NULL").count() == 0
