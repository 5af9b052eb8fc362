"""Excerpts of a line: programmes against cell-by-cell ones, decisions on made takes."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import excerpts as X

NOTES = "u int, beat double, length double, measure long, pitch double"
EVENTS = "u int, start double, stop double, pitch double"


def apart(x, y):
    a = abs(x - y)
    return min(2.5, a, abs(a - 12) + 0.75)


def cells(heard, written, width):
    """The programme by its cells: cost[i][j] and the move there."""
    n, m = len(heard), min(len(written), width)
    inf = float("inf")
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    move = [[0] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if abs(i - j) > X.band_of(n):
                continue
            ways = [(cost[i - 1][j - 1] + apart(heard[i - 1], written[j - 1]), 1)]
            if i > 1 and j > 1:
                ways += [(cost[i - 1][j] + 1.25, 2), (cost[i][j - 1] + 0.85, 3)]
            cost[i][j], move[i][j] = min(ways, key=lambda w: (round(w[0], 9), w[1]))
    return cost, move


def prefix_truth(heard, written, most=64):
    heard = heard[:most]
    n = len(heard)
    least = max(6, int(n * 0.65))
    out = {}
    for s in range(len(written)):
        rest = written[s : s + 2 * n + 4]
        a = abs(heard[0] - rest[0])
        if min(a, abs(a - 12)) > 1.5 or len(rest) < least:
            continue
        cost, _ = cells(heard, rest, 2 * n + 4)
        best = min(cost[n][least:], default=float("inf"))
        if np.isfinite(best):
            out[s] = best / n
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("block", [7, 4096])
def test_prefix_costs_agree_with_cells_whatever_the_blocks(spark, block):
    rng = np.random.default_rng(1)
    lines = {u: rng.integers(40, 60, size=m) + rng.choice([0, 0.3], m) for u, m in ((1, 5), (2, 40), (3, 150), (4, 61))}
    takes = {u: np.concatenate([x[len(x) // 3 : len(x) // 3 + n], [50.0] * (n // 5)]) for (u, x), n in zip(lines.items(), (4, 15, 70, 40))}
    heard = frame(spark, [(u, i, float(p)) for u, x in takes.items() for i, p in enumerate(x)], "u int, i long, pitch double")
    written = frame(spark, [(u, k, float(p)) for u, x in lines.items() for k, p in enumerate(x)], "u int, k long, pitch double")
    got = {(r["u"], r["start"]): r["cost"] for r in X.prefix_costs(heard, written, ["u"], block=block).collect()}
    want = {(u, s): c for u in lines for s, c in prefix_truth(takes[u].tolist(), lines[u].tolist()).items()}
    assert got == pytest.approx(want, abs=1e-6) and len(want) > 20


def test_whole_paths_agree_with_cells(spark):
    rng = np.random.default_rng(2)
    line = rng.integers(40, 90, size=120).astype(float)
    take = np.delete(line[30:80].copy(), [7, 20])
    take[5] -= 12
    take = np.insert(take, 12, 41.0)
    n = len(take)
    starts = frame(spark, [(1, s, n) for s in (0, 29, 30, 31, 75, 110, 115)], "u int, start long, n long")
    heard = frame(spark, [(1, i, float(p)) for i, p in enumerate(take)], "u int, i long, pitch double")
    written = frame(spark, [(1, k, float(p)) for k, p in enumerate(line)], "u int, k long, pitch double")
    got = {r["start"]: r for r in X.whole_paths(heard, written, starts, ["u"]).collect()}
    for s in (0, 29, 30, 31, 75, 110, 115):
        rest = line[s:]
        cost, move = cells(take, rest, len(rest))
        least = max(4, n // 10)
        ends = [round(c, 9) for c in cost[n][least:]]
        if len(rest) < 8 or not np.isfinite(min(ends, default=np.inf)):
            assert s not in got
            continue
        j = ends.index(min(ends)) + least
        assert abs(got[s]["cost"] - cost[n][j] / n) < 1e-6 and got[s]["end"] == s + j - 1
        pairs, i = [], n
        while i and j:
            if move[i][j] == 1:
                pairs.append((s + j - 1, i - 1))
                i, j = i - 1, j - 1
            elif move[i][j] == 2:
                i -= 1
            else:
                j -= 1
        assert [(p["k"], p["i"]) for p in got[s]["pairs"]] == pairs[::-1]


def steps(n, low=48, step=7, span=40):
    return [low + i * step % span for i in range(n)]


def score(u, pitches, length=1.0):
    return [(u, i * length, length, i + 1, float(p)) for i, p in enumerate(pitches)]


def take(u, pitches, spacing=0.5, start=0.3):
    return [(u, start + i * spacing, start + (i + 0.7) * spacing, float(p)) for i, p in enumerate(pitches)]


def test_takes_of_every_kind(spark):
    line = steps(40)
    lost = line[10:30]
    lost = [p - 12 if i == 2 else p for i, p in enumerate(lost[:4] + lost[5:])]
    late = take(4, line)
    late[-1] = (4, late[-1][1] + 30, late[-1][2] + 30, late[-1][3])
    brief = take(5, line[:12])
    brief[-1] = (5, brief[-1][1] + 30, brief[-1][2] + 30, brief[-1][3])
    slower = [(6, a + i * i * 0.001, z + i * i * 0.001, p) for i, (_, a, z, p) in enumerate(take(6, line))]
    ends = [84, 83, 81, 79, 77, 76, 74, 72, 71, 69], [49, 50, 52, 53, 55, 57, 59, 60, 62, 64]
    phrase = steps(20)
    heard = {
        1: take(1, line[10:30]), 2: take(2, steps(100)), 3: take(3, lost), 4: late, 5: brief, 6: slower, 7: take(7, phrase + ends[1]), 8: take(8, phrase),
        9: [(9, i * 0.4, i * 0.4 + 0.3, 60.0) for i in range(12)], 10: take(10, line[:5]), 11: take(11, line[12:32], spacing=0.25), 12: take(12, line[12:32], spacing=0.25), 13: take(13, line[12:32]),
    }
    written = {1: score(1, line), 2: score(2, steps(100)), 3: score(3, line), 4: score(4, line), 5: score(5, line[:12]), 6: score(6, line), 7: score(7, phrase + ends[0] + steps(30, 60, 5, 24) + phrase + ends[1])}
    written |= {8: score(8, phrase + phrase), 9: score(9, line), 10: score(10, line), 11: score(11, line, 0.5), 12: score(12, line, 0.5), 13: score(13, line[:6])}
    pulses = frame(spark, [(11, 0.75), (12, 0.17)], "u int, pulse double")
    rows = X.align_excerpt(frame(spark, sum(heard.values(), []), EVENTS), frame(spark, sum(written.values(), []), NOTES), ["u"], pulses=pulses, block=16)
    got = {r["u"]: r for r in rows.collect()}
    assert set(got) == set(heard)
    ok = lambda u: (got[u]["start"], got[u]["end"], got[u]["confident"])
    assert ok(1) == (10, 29, True) and [m["measure"] for m in got[1]["measures"]] == list(range(11, 31))
    assert abs(got[1]["slope"] - 0.5) < 0.02 and got[1]["residual_ms"] < 60 and got[1]["coverage"] >= 0.9 and abs(got[1]["measures"][0]["t"] - 0.3) < 0.01
    assert ok(2) == (0, 99, True) and got[2]["cost"] == 0
    assert ok(3) == (10, 29, True)
    # a tail off the line goes; a short take with one is not trusted
    assert got[4]["end"] == 38 and got[4]["boundary"] and got[4]["trimmed"] == round(late[-2][1], 3) and got[4]["last_t"] == late[-2][2] and got[4]["end_t"] < late[-2][2] + 1
    assert (got[5]["boundary"], got[5]["confident"], got[5]["end_t"], got[5]["trimmed"]) == (False, False, None, None)
    assert got[6]["boundary"] and abs(got[6]["end_t"] - slower[-1][1] - got[6]["slope"]) < 0.003
    assert ok(7) == (60, 89, True)
    assert [got[u]["refused"] for u in (8, 9, 10, 13)] == ["ambiguous", "unlike", "short", "short"]
    assert all(got[u]["start"] is None and got[u]["confident"] is None for u in (8, 9, 10, 13))
    assert ok(11) == (12, 31, True) and abs(got[11]["slope"] - 0.5) < 0.03
    assert ok(12) == (12, 31, False)  # no pulse of 0.17 s fits


def test_a_start_is_located_unless_first_events_disagree(spark):
    line = steps(60, 50, 7, 44)
    twice = steps(24) + [90 - p for p in steps(30)] + steps(24)
    heard = [(1, i, float(p)) for i, p in enumerate(line[:20])] + [(2, i, float(p)) for i, p in enumerate(twice[:20])] + [(3, i, float(p)) for i, p in enumerate(line[5:45])] + [(4, i, float(p)) for i, p in enumerate(line[:7])]
    written = [(u, k, float(p)) for u, x in ((1, line), (2, twice), (3, line), (4, line)) for k, p in enumerate(x)]
    schema = "u int, s long, p double"
    got = {r["u"]: (r["start"], r["located"]) for r in X.locate(frame(spark, heard, schema), frame(spark, written, schema), ["u"], "s", "p").collect()}
    assert got == {1: (0, True), 2: (None, False), 3: (5, True), 4: (None, False)}


def test_empty_and_single(spark):
    none = frame(spark, [], EVENTS)
    assert X.align_excerpt(none, frame(spark, score(1, steps(9)), NOTES), ["u"]).count() == 0
    one = X.align_excerpt(frame(spark, take(1, [60]), EVENTS), frame(spark, [], NOTES), ["u"]).first()
    assert one["refused"] == "short" and one["measures"] is None
