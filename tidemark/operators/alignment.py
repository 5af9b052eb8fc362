"""Sequence alignment: edit costs, excerpt location, lines, votes, warping.

What has a closed form is DataFrame code. Dynamic programmes run as grouped
pandas functions over one pair of sequences: groups are takes or documents,
bounded by their length, and are hash-dealt over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cogroup, ready

#: An extra event's cost, and what an octave error adds.
EXTRA, OCTAVE = 0.8, 0.75


def pitch_cost(heard: Column, written: Column) -> Column:
    """Semitones apart, an octave discounted, 2.5 at most."""
    apart = F.abs(heard - written)
    return F.least(F.lit(2.5), apart, F.abs(apart - 12) + OCTAVE)


def usable_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events (start, stop, pitch) that are finite, in range, long enough and start after the one before ends (1 ms allowed)."""
    from pyspark.sql import Window

    ok = F.col("start").isNotNull() & ~F.isnan("start") & (F.col("stop") - F.col("start") >= 0.09) & F.col("pitch").between(36, 96)
    good = events.where(ok)
    return good.withColumn("_e", F.lag("stop").over(Window.partitionBy(*keys).orderBy("start", "pitch"))).where(F.col("_e").isNull() | (F.col("start") >= F.col("_e") - 0.001)).drop("_e")


def theil_sen(points: DataFrame, keys: list[str], x: str, y: str, apart: float) -> DataFrame:
    """(pairs, slope, intercept): median slope of pairs of a group at least so far apart, and median of what is left.

    Pairs are drawn within a group, which is a take or a customer.
    """
    p = points.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    q = points.select(*keys, F.col(x).alias("x2"), F.col(y).alias("y2"))
    slope = p.join(q, keys).where(F.col("x2") - F.col("x") >= apart).groupBy(*keys).agg(F.median((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))).alias("slope"), F.count("*").alias("pairs"))
    return p.join(slope, keys).groupBy(*keys, "pairs", "slope").agg(F.median(F.col("y") - F.col("slope") * F.col("x")).alias("intercept"))


def vote(tried: DataFrame, keys: list[str], candidate: str, hit: Column) -> DataFrame:
    """Of candidates, the one with the largest share of hits (ties: the smallest)."""
    rate = tried.groupBy(*keys, candidate).agg(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 9).alias("rate"))
    best = rate.groupBy(*keys).agg(F.max(F.struct("rate", (-F.col(candidate)).alias("c"))).alias("m"))
    return best.select(*keys, (-F.col("m.c")).alias(candidate), F.col("m.rate").alias("rate"))


def pulse_fits(slope: Column, beat: Column) -> Column:
    """Whether seconds a beat are a common multiple of the beat interval found."""
    ratios = F.array(*(F.lit(r) for r in (0.5, 2 / 3, 1.0, 1.5, 2.0)))
    return F.exists(ratios, lambda r: F.abs(slope / (beat * r) - 1.0) <= 0.12)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: one row at a time, in the JVM."""
    begin = F.transform(b, lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        cells = F.arrays_zip(b.alias("y"), before.alias("up"), F.concat(F.array(F.lit(0)), before).alias("corner"))
        cells = F.slice(cells, F.lit(1), F.size(b))
        return F.aggregate(cells, F.array().cast("array<int>"), lambda done, c: F.concat(done, F.array(F.when(c["y"] == x, c["corner"] + 1).otherwise(F.greatest(c["up"], F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)))))))

    return F.coalesce(F.try_element_at(F.aggregate(a, begin, row), F.lit(-1)), F.lit(0))


def edit_path(heard: np.ndarray, written: np.ndarray, band: int | None = None, extra: float = EXTRA, missed: float = 1.0) -> tuple[float, list[tuple[int, int]]]:
    """Cheapest alignment of two pitch sequences: (cost, matched index pairs).

    Row by row over what was heard; within a row skips are a running minimum,
    so a row is a few vector operations. Ties prefer match, then extra, then skip.
    """
    n, m = len(heard), len(written)
    band = max(n, m) if band is None else band
    skip = missed * np.arange(m + 1)
    best, back = skip.copy(), np.zeros((n + 1, m + 1), dtype=np.int8)
    back[0, 1:] = 3
    for i in range(1, n + 1):
        apart = np.abs(heard[i - 1] - written)
        cost = np.minimum(2.5, np.minimum(apart, np.abs(apart - 12) + OCTAVE))
        far = np.abs(np.arange(m) - (i - 1) * m / max(n, 1)) > band
        take = np.where(far, np.inf, best[:-1] + cost)
        drop = best + extra
        base = drop.copy()
        kind = np.full(m + 1, 2, dtype=np.int8)
        better = take <= drop[1:]
        base[1:][better], kind[1:][better] = take[better], 1
        run = np.minimum.accumulate(base - skip) + skip
        kind[run < base - 1e-12] = 3
        best, back[i] = run, kind
    pairs, i, j = [], n, m
    while i or j:
        k = back[i, j]
        if k == 1:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif k == 2:
            i -= 1
        else:
            j -= 1
    return float(best[m]), pairs[::-1]


def edit_costs(heard: np.ndarray, windows: np.ndarray, band: int, extra: float = EXTRA, missed: float = 1.0) -> np.ndarray:
    """Costs of ``edit_path`` against many windows (a row each) at once; not a number stands for no note, at a row's end."""
    n, m = len(heard), windows.shape[1]
    sizes = (~np.isnan(windows)).sum(1)
    skip = missed * np.arange(m + 1)
    best = np.tile(skip, (len(windows), 1))
    for i in range(1, n + 1):
        apart = np.abs(heard[i - 1] - windows)
        cost = np.minimum(2.5, np.minimum(apart, np.abs(apart - 12) + OCTAVE))
        far = np.abs(np.arange(m) - (i - 1) * sizes[:, None] / max(n, 1)) > band
        take = np.where(far | np.isnan(cost), np.inf, best[:, :-1] + cost)
        base = best + extra
        base[:, 1:] = np.minimum(base[:, 1:], take)
        best = np.minimum.accumulate(base - skip, axis=1) + skip
    return best[np.arange(len(windows)), sizes]


def align(heard: DataFrame, written: DataFrame, keys: list[str], seq: str, value: str, band: int | None = None) -> DataFrame:
    """Matched places of two sequences of each key: (heard_seq, written_seq, cost), cost of the whole alignment."""
    spec = T.StructType([*(heard.schema[k] for k in keys), T.StructField("heard_seq", T.LongType()), T.StructField("written_seq", T.LongType()), T.StructField("cost", T.DoubleType())])

    def fold(key, a, b):
        if not len(a) or not len(b):
            return []  # nothing meets
        (left, x), (right, y) = ((s[seq].to_numpy(), s[value].to_numpy(float)) for s in (a, b))
        one, two = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
        cost, pairs = edit_path(x[one], y[two], band)
        return [(*key, int(left[one[i]]), int(right[two[j]]), round(cost, 3)) for i, j in pairs]

    return cogroup(heard.select(*keys, seq, value), written.select(*keys, seq, value), keys, fold, spec)


def locate(heard: DataFrame, written: DataFrame, keys: list[str], seq: str, value: str, *, most: int = 64, limit: float = 0.70, margin: float = 0.16) -> DataFrame:
    """Where in the written sequence an excerpt starts: (start, cost, runner_up, located).

    Every start is tried, and the cost of each is kept, so that an excerpt that
    fits two places is refused: located is false, and start null.
    """
    spec = T.StructType([*(heard.schema[k] for k in keys), T.StructField("start", T.LongType()), T.StructField("cost", T.DoubleType()), T.StructField("runner_up", T.DoubleType()), T.StructField("located", T.BooleanType())])

    def fold(key, a, b):
        x, y = a.sort_values(seq)[value].to_numpy(float)[:most], b.sort_values(seq)[value].to_numpy(float)
        columns = [*keys, "start", "cost", "runner_up", "located"]
        if not len(x) or not len(y):
            return pd.DataFrame([(*key, None, None, None, False)], columns=columns)
        filled = np.concatenate([y, np.full(max(0, len(x) - len(y)), np.nan)])
        costs = edit_costs(x, np.lib.stride_tricks.sliding_window_view(filled, len(x)), max(4, len(x) // 3)) / len(x)
        best = int(costs.argmin())
        away = np.abs(np.arange(len(costs)) - best) > 1
        second = float(costs[away].min()) if away.any() else float("inf")
        sure = costs[best] <= limit and second - costs[best] >= margin
        return pd.DataFrame([(*key, best if sure else None, round(float(costs[best]), 3), round(second, 3) if np.isfinite(second) else None, sure)], columns=columns).astype({"start": "Int64"})

    return cogroup(heard.select(*keys, seq, value), written.select(*keys, seq, value), keys, fold, spec)


#: What a pair's likeness earns, what one without any costs, and a skipped group and cluster.
LIKENESS, LESS, UNLIKE, SKIPPED_GROUP, SKIPPED_CLUSTER = 2.0, 0.6, -1.0, -0.45, -0.25


def best_chain(reward: np.ndarray, skip_row: float, skip_column: float, *, free_rows_before: bool, free_rows_after: bool, free_columns: bool) -> list[tuple[int, int]]:
    """Pairs (row, column), rising in both, of the highest total reward less what is skipped.

    ``free_columns``: columns before the first pair and after the last cost
    nothing; ``free_rows_before`` and ``free_rows_after`` say so of rows. A chain
    starts at an edge, so of what is ahead of both sides one is skipped for free. Sums are
    made by diagonals, whose cells don't depend on each other; the way back asks
    at each cell which move its sum came from (a pair first, then a row skipped).
    """
    n, m = reward.shape
    total = np.zeros((n + 1, m + 1))
    total[:, 0] = 0.0 if free_rows_before else skip_row * np.arange(n + 1)
    total[0] = 0.0 if free_columns else skip_column * np.arange(m + 1)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        total[i, j] = np.maximum(np.maximum(total[i - 1, j - 1] + reward[i - 1, j - 1], total[i - 1, j] + skip_row), total[i, j - 1] + skip_column)
    rows = slice(0 if free_rows_after else n, n + 1)
    columns = slice(0 if free_columns else m, m + 1)
    ends = total[rows, columns]
    i, j = np.unravel_index(int(np.argmax(ends)), ends.shape)
    i, j, chain = int(i) + (rows.start or 0), int(j) + (columns.start or 0), []
    while i and j:
        if total[i, j] <= total[i - 1, j - 1] + reward[i - 1, j - 1] + 1e-9:
            i, j = i - 1, j - 1
            chain.append((i, j))
        elif total[i, j] <= total[i - 1, j] + skip_row + 1e-9:
            i -= 1
        else:
            j -= 1
    return chain[::-1]


def dice_path(sim: np.ndarray, free_start: bool = True) -> list[tuple[int, int]]:
    """Best monotone pairing of a score's groups (rows) and a take's clusters by likeness.

    Clusters and groups after the pairs cost nothing (the take stopped early, or
    went on), nor do clusters before them (noise, other passages) or, with
    ``free_start``, groups before them, whichever costs more; not both.
    """
    if not sim.size:
        return []
    reward = np.where(sim > 0, LIKENESS * sim - LESS, UNLIKE)
    return best_chain(reward, SKIPPED_GROUP, SKIPPED_CLUSTER, free_rows_before=free_start, free_rows_after=True, free_columns=True)


def dtw_cost(a: list, b: list, gap: float = 0.3) -> float:
    """Cost of pairing two sequences of bags in order: 1 less their multiset agreement, or a gap."""
    from collections import Counter

    def apart(x, y) -> float:
        x, y = Counter(x), Counter(y)
        total = sum(x.values()) + sum(y.values())
        return 0.0 if not total else 1.0 - 2.0 * sum((x & y).values()) / total

    row = [gap * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [gap * i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j - 1] + apart(x, y), row[j] + gap, now[-1] + gap))
        row = now
    return row[-1]


def shift_path(residuals: np.ndarray, shifts: np.ndarray, jump: float) -> np.ndarray:
    """Cheapest shift of each measure: its residual plus a cost for changing the shift (Viterbi)."""
    n, k = residuals.shape
    move = jump * np.abs(shifts[:, None] - shifts[None, :])
    best, back = residuals[0].copy(), np.zeros((n, k), dtype=int)
    for i in range(1, n):
        total = best[:, None] + move
        back[i] = total.argmin(0)
        best = total.min(0) + residuals[i]
    path = [int(best.argmin())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return shifts[path[::-1]]


def reject_outliers(points: DataFrame, keys: list[str], x: str, y: str, *, around: int = 3, least: float = 0.12, times: float = 4.0, passes: int = 2) -> DataFrame:
    """Points that stay when those far off the line of their neighbours go, pass by pass."""
    ready(points.sparkSession)
    spec = points.select(*keys, x, y).schema

    def fold(pdf):
        pdf = pdf.sort_values(x).reset_index(drop=True)
        for _ in range(passes):
            a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
            if len(a) < 4:
                break
            off = np.zeros(len(a))
            for i in range(len(a)):
                near = [j for j in range(max(0, i - around), min(len(a), i + around + 1)) if j != i]
                slope, level = np.polyfit(a[near], b[near], 1) if np.ptp(a[near]) > 0 else (0.0, b[near].mean())
                off[i] = abs(b[i] - slope * a[i] - level)
            keep = off <= max(least, times * float(np.median(off)))
            if keep.all():
                break
            pdf = pdf[keep].reset_index(drop=True)
        return pdf

    return points.select(*keys, x, y).groupBy(*keys).applyInPandas(fold, spec)


def grid_disagrees(points: DataFrame, keys: list[str], x: str, y: str, start: Column, slope: Column, most: float = 0.5) -> DataFrame:
    """(points, deviation, disagrees): whether aligned points lie farther than ``most`` from a grid's line.

    Fewer than two points, or points that don't rise in both, say nothing: null.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(x)
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_far": F.abs(start + F.col(x) * slope - F.col(y)), "_rises": F.coalesce((F.col(x) > F.lag(x).over(w)) & (F.col(y) > F.lag(y).over(w)), F.lag(x).over(w).isNull())})
    out = p.groupBy(*keys).agg(F.count("*").alias("points"), F.max("_far").alias("deviation"), F.bool_and("_rises").alias("_ok"))
    good = (F.col("points") >= 2) & F.col("_ok")
    return out.select(*keys, "points", F.when(good, F.col("deviation")).alias("deviation"), F.when(good, F.col("deviation") > most).alias("disagrees"))


def segment_tempo(anchors: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(segments, tempo): median seconds a beat of the segments between anchors, without those of more than twice the upper median."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(x)
    s = anchors.withColumns({"_dx": F.lead(x).over(w) - F.col(x), "_dy": F.lead(y).over(w) - F.col(y)}).where("_dx > 0 AND _dy > 0")
    rates = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("_dy") / F.col("_dx"))).alias("r"))
    kept = F.filter("r", lambda r: r <= 2 * F.get(F.col("r"), F.floor(F.size("r") / 2).cast("int")))
    middle = F.element_at(F.transform(F.array(kept), lambda k: (F.get(k, F.floor((F.size(k) - 1) / 2).cast("int")) + F.get(k, F.floor(F.size(k) / 2).cast("int"))) / 2), 1)
    return rates.where(F.size("r") >= 2).select(*keys, F.size("r").cast("long").alias("segments"), middle.alias("tempo"))


#: Fixed values of a lead-in: notes of the opening, seconds within which it starts, least seconds ahead of it, share found, and gain over the take's start.
OPENING, LATEST, SOONEST, FOUND, GAIN = 12, 60.0, 1.5, 0.6, 0.25


def _shares(windows: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Of each window of pitches the share of the opening that it has in order, a semitone allowed; all windows at once."""
    best = np.zeros((len(windows), len(opening) + 1), dtype=int)
    for column in windows.T:
        meets = np.abs(column[:, None] - opening) <= 1.0
        taken = np.where(meets, best[:, :-1] + 1, 0)
        best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], taken), axis=1)
    return best[:, -1] / len(opening)


def lead_ins(heard: DataFrame, opening: DataFrame, keys: list[str]) -> DataFrame:
    """(start) of each key whose take begins with something else, tuning say: the second at which the score's opening does.

    Events (t, pitch) and the score's first notes (k, pitch) are compared as far
    as twelve notes go. Null unless a later window has .6 of the opening in order,
    and .25 more of it than the take's start; then it is the earliest window about
    as good that begins with one of the first two notes, if 1.5 seconds are ahead.
    """
    spec = T.StructType([*(heard.schema[k] for k in keys), T.StructField("start", T.DoubleType())])

    def fold(key, a, b):
        a, notes = a.sort_values(["t", "pitch"]), b.sort_values("k")["pitch"].to_numpy(float)[:OPENING]
        t, p = a["t"].to_numpy(float), a["pitch"].to_numpy(float)
        start = None
        if len(notes) >= 8 and len(p) >= len(notes):
            tried = np.flatnonzero(t - t[0] <= LATEST)
            width = len(notes) + 3
            windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([p, np.full(width, np.inf)]), width)[tried]
            share = _shares(windows, notes)
            if share.max() >= FOUND and share[0] <= share.max() - GAIN:
                first = (share >= share.max() - 0.05) & (np.abs(p[tried][:, None] - notes[:2]) <= 1.0).any(axis=1)
                if first.any():
                    at = float(t[tried[np.flatnonzero(first)[0]]])
                    start = at if at - t[0] >= SOONEST else None
        return pd.DataFrame([(*key, start)] if len(a) else [], columns=spec.fieldNames())

    return cogroup(heard.select(*keys, "t", "pitch"), opening.select(*keys, "k", "pitch"), keys, fold, spec)


def _likeness(a: list[dict], b: list[dict]) -> np.ndarray:
    """Dice agreement of bags (value -> count): two empty ones agree."""
    values = sorted({v for x in (*a, *b) for v in x})
    x, y = (np.array([[bag.get(v, 0) for v in values] for bag in side], dtype=float).reshape(len(side), len(values)) for side in (a, b))
    common = sum((np.minimum.outer(x[:, k], y[:, k]) for k in range(len(values))), np.zeros((len(a), len(b))))
    total = x.sum(1)[:, None] + y.sum(1)[None, :]
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


def measure_pairs(sim: np.ndarray, gap: float = 0.3) -> dict[int, list[int]]:
    """Columns paired with each row by warping: all rows, columns at either end free; a row or column that goes on costs ``gap`` more."""
    n, m = sim.shape
    cost = 1 - sim
    total = np.full((n + 1, m + 1), np.inf)
    total[0] = 0.0
    for i in range(1, n + 1):
        fresh = np.minimum(total[i - 1, :-1], total[i - 1, 1:] + gap) + cost[i - 1]
        # What goes on from the left: a running minimum once the cells' own costs are taken out.
        ahead = np.cumsum(cost[i - 1] + gap)
        total[i, 1:] = np.minimum.accumulate(fresh - ahead) + ahead
    pairs: dict[int, list[int]] = {}
    i, j = n, int(np.argmin(total[n, 1:])) + 1
    while i and j:
        pairs.setdefault(i - 1, []).append(j - 1)
        ways = [(total[i - 1, j - 1], 0, -1, -1), (total[i - 1, j] + gap, 1, -1, 0), (total[i, j - 1] + gap, 2, 0, -1)]
        _, _, di, dj = min(ways, key=lambda w: (round(w[0], 9), w[1]))
        i, j = i + di, j + dj
    return pairs


def compared_readings(primary: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(measure, paired, pitch, onset) of each measure of a reading: the other reading's measures that stand for it, and how far both agree.

    Notes have (measure, midi, at), ``at`` in quarters from the measure's start.
    Measures may be split or merged, and the other reading may have more at
    either end. Agreement is the F1 of the bags of keys, and of keys with their
    place to a twelfth; a reading without notes is compared with nothing.
    """
    from collections import Counter

    spec = T.StructType([*(primary.schema[k] for k in keys), T.StructField("measure", T.LongType()), T.StructField("paired", T.ArrayType(T.LongType())), T.StructField("pitch", T.DoubleType()), T.StructField("onset", T.DoubleType())])

    def fold(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=spec.fieldNames())
        sides = [[(int(m), g) for m, g in x.groupby("measure")] for x in (a, b)]
        bags = [[dict(Counter(g["midi"].tolist())) for _, g in side] for side in sides]
        pairs = measure_pairs(_likeness(*bags))
        places = [[dict(Counter(zip(g["midi"].tolist(), np.round(g["at"] * 12).astype(int).tolist()))) for _, g in side] for side in sides]
        rows = []
        for i, (measure, _) in enumerate(sides[0]):
            theirs = sorted(set(pairs.get(i, [])))
            both = [sum((Counter(kind[1][j]) for j in theirs), Counter()) for kind in (bags, places)]
            agree = [round(float(_likeness([kind[0][i]], [dict(x)])[0, 0]), 3) for kind, x in zip((bags, places), both)]
            rows.append((*key, measure, [sides[1][j][0] for j in theirs], *agree))
        return pd.DataFrame(rows, columns=spec.fieldNames())

    names = [*keys, "measure", "midi", "at"]
    return cogroup(primary.select(*names), other.select(*names), keys, fold, spec)
