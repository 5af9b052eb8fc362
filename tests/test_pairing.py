"""Pairing folds on small takes, and against exhaustive search."""

from __future__ import annotations

import itertools
import random

import numpy as np

from tidemark.operators import pairing as P


def test_monotone_pairs_are_as_many_and_as_close_as_any():
    rng = random.Random(1)
    for _ in range(40):
        a, b = (sorted(round(rng.random() * 3, 2) for _ in range(rng.randrange(1, 5))) for _ in range(2))
        got = P.monotone_pairs(np.array(a), np.array(b), 0.5)
        worth = lambda pairs: sum(1 - abs(a[i] - b[j]) for i, j in pairs)
        best = 0.0
        for k in range(1, min(len(a), len(b)) + 1):
            for x, y in itertools.product(itertools.combinations(range(len(a)), k), itertools.combinations(range(len(b)), k)):
                if all(abs(a[i] - b[j]) <= 0.5 for i, j in zip(x, y, strict=True)):
                    best = max(best, worth(list(zip(x, y, strict=True))))
        assert abs(worth(got) - best) < 1e-9


def rows(df):
    return sorted(tuple(r)[1:] for r in df.collect())


def test_steps_of_a_take(spark):
    kind = "take int, id long, midi int, t double"
    notes = spark.createDataFrame([(1, 1, 60, 0.0), (1, 2, 62, 1.0), (1, 3, 64, 2.0), (1, 4, 65, 3.0)], kind)
    heard = spark.createDataFrame([(1, 11, 60, 0.02), (1, 12, 63, 1.05), (1, 13, 64, 2.1), (1, 14, 77, 3.02), (1, 15, 64, 2.6)], kind)
    assert sorted((r["note"], r["heard"]) for r in P.same_pitch(notes, heard, ["take"], 0.5).collect()) == [(1, 11), (3, 13)]
    missed, extra = notes.where("id IN (2, 4)"), heard.where("id IN (12, 14, 15)")
    assert rows(P.wrong_notes(missed, extra, ["take"], 0.5)) == [(2, 12)]
    assert rows(P.octave_conflicts(missed, extra, ["take"])) == [(4, 14)]
    n = spark.createDataFrame([(1, 1, 60, 0.0, 11), (1, 2, 64, 1.0, None), (1, 3, 64, 2.0, 13)], "take int, id long, midi int, t double, heard long")
    h = spark.createDataFrame([(1, 11, 60, 0.0, True), (1, 12, 64, 1.2, False), (1, 13, 64, 2.0, True), (1, 14, 64, 5.0, False)], "take int, id long, midi int, t double, used boolean")
    assert rows(P.fill_gaps(n, h, ["take"])) == [(2, 12)]


def test_choices(spark):
    e = spark.createDataFrame([(1, 0.21), (1, 0.19), (1, 0.2), (2, 0.004), (2, -0.004)], "take int, e double")
    assert [(round(o, 6), round(r, 6)) for o, r in rows(P.offset_search(e, ["take"], "e"))] == [(0.0, 0.004), (0.2, 0.01)]
    c = spark.createDataFrame([(1, 0.0, 3.0), (1, 0.02, 2.0), (1, 0.1, 4.0), (1, 0.3, 9.0), (1, 0.5, 9.5)], "take int, p double, c double")
    assert sorted(r[0] for r in rows(P.spaced_best(c, ["take"], "p", "c", 0.06))) == [0.02, 0.1, 0.3]
    q = spark.createDataFrame([(1, "plain", 0.5), (1, "up", 0.6), (2, "plain", 0.5), (2, "up", 0.8)], "take int, name string, f double")
    assert {r["take"]: r["name"] for r in P.best_reading(q, ["take"], "name", "f", "plain").collect()} == {1: "plain", 2: "up"}
    s = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 20.0, 30.0)], "page int, id long, top double, bottom double")
    t = spark.createDataFrame([(1, 5, 1.0, 11.0), (1, 6, 27.0, 40.0)], "page int, id long, top double, bottom double")
    assert rows(P.overlapping_systems(s, t, ["page"])) == [(1, 5)]
    assert P.place_voice([1.0, 1.0], 4.0, {0.0, 2.0})[0] == [0.0, 2.0] and P.place_voice([3.0, 2.0], 4.0, set()) is None
    i = spark.createDataFrame([(1, 1, 0.0), (1, 2, 2.0)], "take int, measure int, start double")
    n = spark.createDataFrame([(1, 7, 1, 0.0, 0.01), (1, 8, 1, 1.0, 1.0), (1, 9, 2, 0.0, 1.98)], "take int, id long, measure int, beat double, t double")
    assert sorted((r["measure"], r["note"]) for r in P.follow_anchors(i, n, ["take"]).collect()) == [(1, 7), (2, 9)]
