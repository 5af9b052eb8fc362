"""Pairing of what was written with what was heard, step by step, within a take.

Each is a grouped fold over one take (or one take and pitch), whose rows are
bounded by its length; takes are hash-dealt over tasks. Ties go to the earlier
row, so results don't depend on row order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cogroup, ready


def _cogroup(left: DataFrame, right: DataFrame, keys: list[str], columns: list[tuple[str, T.DataType]], rule: Callable[[pd.DataFrame, pd.DataFrame], list[tuple]]) -> DataFrame:
    spec = T.StructType([*(left.schema[k] for k in keys), *(T.StructField(n, t) for n, t in columns)])

    def fold(key, a, b):
        return [(*key, *row) for row in rule(a, b)]

    return cogroup(left, right, keys, fold, spec)


_PAIR = [("note", T.LongType()), ("heard", T.LongType())]


def monotone_pairs(notes: np.ndarray, heard: np.ndarray, window: float) -> list[tuple[int, int]]:
    """Of two rising lists of times, the pairs in order that are most, and closest in sum, within the window."""
    n, m = len(notes), len(heard)
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        gain = np.where(np.abs(heard - notes[i - 1]) <= window, 1.0 - 0.5 * np.abs(heard - notes[i - 1]) / window, -np.inf)
        best[i] = np.maximum.accumulate(np.maximum(best[i - 1], np.concatenate(([0.0], best[i - 1][:-1] + gain))))
    pairs, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return pairs[::-1]


def _in_order(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(t, id) of rows by both."""
    t, ident = rows["t"].to_numpy(float), rows["id"].to_numpy()
    order = np.lexsort((ident, t))
    return t[order], ident[order]


def same_pitch(notes: DataFrame, heard: DataFrame, keys: list[str], window: float) -> DataFrame:
    """(note, heard) of equal pitch, in order within each pitch: a take's pitches are groups of their own."""

    def rule(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple]:
        if not len(a) or not len(b):
            return []
        (x, i), (y, j) = (_in_order(side) for side in (a, b))
        return [(int(i[n]), int(j[m])) for n, m in monotone_pairs(x, y, window)]

    return _cogroup(notes.select(*keys, "midi", "id", "t"), heard.select(*keys, "midi", "id", "t"), [*keys, "midi"], _PAIR, rule)


def _greedy(costs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    out, left, right = [], set(), set()
    for _, i, j in sorted(costs):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j))
    return out


def wrong_notes(missed: DataFrame, extra: DataFrame, keys: list[str], window: float, most: int = 4) -> DataFrame:
    """Missed notes with what was played instead: up to ``most`` semitones off and .6 of the window away, cheapest first."""
    reach = 0.6 * window

    def rule(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple]:
        b = b.sort_values("t")
        times = b["t"].to_numpy(float)
        costs = []
        for r in a.itertuples(index=False):
            for k in range(int(np.searchsorted(times, r.t - reach)), int(np.searchsorted(times, r.t + reach, "right"))):
                apart = abs(float(b["midi"].iloc[k]) - r.midi)
                if 0 < apart <= most:
                    costs.append((apart / most + abs(times[k] - r.t) / reach, int(r.id), int(b["id"].iloc[k])))
        return _greedy(costs)

    return _cogroup(missed.select(*keys, "id", "midi", "t"), extra.select(*keys, "id", "midi", "t"), keys, _PAIR, rule)


def octave_conflicts(missed: DataFrame, extra: DataFrame, keys: list[str], within: float = 0.15) -> DataFrame:
    """Missed notes that sound one or two octaves away at the same time; each extra serves once, the nearest first."""

    def rule(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple]:
        b = b.sort_values("t")
        times = b["t"].to_numpy(float)
        costs = []
        for r in a.itertuples(index=False):
            for k in range(int(np.searchsorted(times, r.t - within)), int(np.searchsorted(times, r.t + within, "right"))):
                if abs(int(b["midi"].iloc[k]) - int(r.midi)) in (12, 24):
                    costs.append((abs(times[k] - r.t), int(r.id), int(b["id"].iloc[k])))
        return _greedy(costs)

    return _cogroup(missed.select(*keys, "id", "midi", "t"), extra.select(*keys, "id", "midi", "t"), keys, _PAIR, rule)


def fill_gaps(notes: DataFrame, heard: DataFrame, keys: list[str]) -> DataFrame:
    """Further pairs of equal pitch for notes (id, midi, t, heard or null) that lie between matched neighbours:
    what was heard (id, midi, t, used) between those neighbours' times, nearest to where the note would fall."""

    def rule(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple]:
        a = a.sort_values(["t", "id"]).reset_index(drop=True)
        at = dict(zip(b["id"], b["t"], strict=True))
        known = [k for k in range(len(a)) if pd.notna(a["heard"].iloc[k])]
        free = b[~b["used"].astype(bool)].sort_values(["t", "id"])
        costs = []
        for k in range(len(a)):
            if pd.notna(a["heard"].iloc[k]):
                continue
            before, after = [j for j in known if j < k], [j for j in known if j > k]
            if not before or not after:
                continue
            i, j = before[-1], after[0]
            lo, hi = at[int(a["heard"].iloc[i])], at[int(a["heard"].iloc[j])]
            width = a["t"].iloc[j] - a["t"].iloc[i]
            expected = lo + (hi - lo) * (a["t"].iloc[k] - a["t"].iloc[i]) / width if width > 0 else lo
            for r in free[(free["midi"] == a["midi"].iloc[k]) & (free["t"] > lo - 0.05) & (free["t"] < hi + 0.05)].itertuples(index=False):
                costs.append((abs(r.t - expected), int(a["id"].iloc[k]), int(r.id)))
        return _greedy(costs)

    return _cogroup(notes.select(*keys, "id", "midi", "t", "heard"), heard.select(*keys, "id", "midi", "t", "used"), keys, _PAIR, rule)


def overlapping_systems(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """One-to-one pairs of vertical extents (id, top, bottom) that share more than ``least`` of the smaller, largest first."""

    def rule(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple]:
        costs = []
        for r in a.itertuples(index=False):
            share = (np.minimum(b["bottom"], r.bottom) - np.maximum(b["top"], r.top)) / np.maximum(np.minimum(b["bottom"] - b["top"], r.bottom - r.top), 1e-9)
            costs += [(-float(s), int(r.id), int(i)) for s, i in zip(share, b["id"], strict=True) if s > least]
        return _greedy(costs)

    return _cogroup(left.select(*keys, "id", "top", "bottom"), right.select(*keys, "id", "top", "bottom"), keys, _PAIR, rule)


def spaced_best(candidates: DataFrame, keys: list[str], place: str, cost: str, apart: float, most: int = 3) -> DataFrame:
    """The cheapest candidates of each key that are far enough from cheaper ones."""
    ready(candidates.sparkSession)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for i in pdf.sort_values([cost, place]).index:
            if len(kept) < most and all(abs(pdf.at[i, place] - pdf.at[k, place]) >= apart - 1e-9 for k in kept):
                kept.append(i)
        return pdf.loc[kept]

    c = candidates.select(*keys, place, cost)
    return c.groupBy(*keys).applyInPandas(fold, c.schema)


def offset_search(pairs: DataFrame, keys: list[str], error: str, reach: float = 0.5, step: float = 0.02, gain: float = 0.015) -> DataFrame:
    """(offset, residual): the common shift of errors with the least median; none unless it gains enough.

    A take's errors are gathered once, and every shift is tried on that list.
    """
    n = round(reach / step)
    held = pairs.where(F.col(error).isNotNull()).groupBy(*keys).agg(F.collect_list(F.col(error).cast("double")).alias("_e"))
    middle = lambda x: (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2
    left = lambda shift: F.element_at(F.transform(F.array(F.array_sort(F.transform("_e", lambda e: F.abs(e - shift)))), middle), 1)
    tried = F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda k: F.round(k * step, 6))
    fits = F.transform(tried, lambda o: F.struct(left(o).alias("residual"), F.abs(o).alias("size"), o.alias("offset")))
    best = held.select(*keys, F.array_min(fits).alias("b"), left(F.lit(0.0)).alias("flat"))
    moved = F.col("flat") - F.col("b.residual") >= gain
    return best.select(*keys, F.when(moved, F.col("b.offset")).otherwise(0.0).alias("offset"), F.when(moved, F.col("b.residual")).otherwise(F.col("flat")).alias("residual"))


def best_reading(candidates: DataFrame, keys: list[str], name: str, quality: str, plain: str, margin: float = 1.3) -> DataFrame:
    """Of readings, the best; the plain one unless another beats it by a factor."""
    held = candidates.groupBy(*keys).agg(F.max(F.struct(quality, F.col(name).alias("reading"))).alias("b"), F.max(F.when(F.col(name) == plain, F.col(quality))).alias("own"))
    keep = F.col("own").isNotNull() & (F.col(f"b.{quality}") < F.col("own") * margin)
    return held.select(*keys, F.when(keep, F.lit(plain)).otherwise(F.col("b.reading")).alias(name), F.when(keep, F.col("own")).otherwise(F.col(f"b.{quality}")).alias(quality))


def place_voice(durations: list[float], length: float, shared: set[float], grid: float = 0.25, gap: float = 1.0, off: float = 0.5, alone: float = 0.2) -> tuple[list[float], float] | None:
    """Onsets for notes that leave a measure short, and their margin over the runner-up.

    Gaps cost as they are long, onsets off the beat or apart from the other
    voices' cost a little; the dynamic programme runs over grid places.
    """
    places = [round(k * grid, 6) for k in range(int(round(length / grid)) + 1)]
    states: dict[float, list[tuple[float, list[float]]]] = {0.0: [(0.0, [])]}
    for d in durations:
        after: dict[float, list[tuple[float, list[float]]]] = {}
        for end, ways in states.items():
            for p in places:
                if p < end - 1e-9 or p + d > length + 1e-9:
                    continue
                extra = gap * (p - end) + (off if abs(p - round(p)) > 1e-9 else 0.0) + (alone if shared and p not in shared else 0.0)
                after.setdefault(round(p + d, 6), []).extend((c + extra, [*o, p]) for c, o in ways)
        states = {e: sorted(w)[:2] for e, w in after.items()}
    final = sorted((c + gap * (length - e), o) for e, w in states.items() for c, o in w)
    if not final:
        return None
    return final[0][1], (final[1][0] - final[0][0] if len(final) > 1 else float("inf"))


def placed_voices(short: DataFrame, keys: list[str], durations: str, length: str, shared: str, least: float = 0.0) -> DataFrame:
    """(onsets, margin) of voices that leave their measure short: ``place_voice`` of each row's durations (array) and the onsets of the other voices (array).

    Null where the notes can't be placed, or where the best placing beats the next by less than ``least``.
    """
    ready(short.sparkSession)
    kinds = ", ".join(f"{k} {short.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for b in batches:
            found = [place_voice([float(x) for x in d], float(n), {float(x) for x in (o if o is not None else ())}) for d, n, o in zip(b[durations], b[length], b[shared])]
            sure = [f if f is not None and f[1] >= least else None for f in found]
            yield pd.DataFrame({**{k: b[k] for k in keys}, "onsets": [f and f[0] for f in sure], "margin": pd.Series([f[1] if f and np.isfinite(f[1]) else None for f in sure], dtype="Float64")})

    return short.select(*keys, durations, length, shared).mapInPandas(run, f"{kinds}, onsets array<double>, margin double")


def follow_anchors(intervals: DataFrame, notes: DataFrame, keys: list[str], slack: float = 0.05) -> DataFrame:
    """The first note at or after each interval's start (downbeat first): where a page turns to."""
    w = Window.partitionBy(*keys).orderBy("start")
    spans = intervals.withColumn("next", F.lead("start").over(w))
    both = spans.alias("i").join(notes.alias("n"), [*(F.col(f"i.{k}") == F.col(f"n.{k}") for k in keys), F.col("n.measure") == F.col("i.measure"), F.col("n.t") >= F.col("i.start") - slack, F.col("n.t") < F.coalesce(F.col("i.next"), F.lit(float("inf"))) + slack])
    return both.groupBy(*(F.col(f"i.{k}").alias(k) for k in keys), F.col("i.measure").alias("measure"), F.col("i.start").alias("start")).agg(F.min_by("n.id", F.struct(F.col("n.beat"), F.col("n.t"))).alias("note"), F.min_by("n.t", F.struct(F.col("n.beat"), F.col("n.t"))).alias("t"))
