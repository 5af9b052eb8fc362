"""Where an excerpt lies in a written line, where it ends, and when its measures are; refused where in doubt.

All starts of a block of the written line are tried in one dynamic programme:
a row of it is (start, offset from the diagonal), so memory is the band's. Blocks
are dealt over tasks, each with the notes that its last starts reach into. Whole
paths are made for the few starts that survive, and one of them decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cogroup, ready

from .alignment import OCTAVE, usable_events

#: Costs of an extra event and of a skipped note, and semitones within which the first note must be met.
EXTRA, SKIP, OPENING = 1.25, 0.85, 1.5
#: Events of a prefix, fewest events or notes, margin and number of the starts that survive.
PREFIX, FEWEST, MARGIN, SURVIVORS = 64, 8, 0.40, 16
#: Dearest prefix and whole path, what another place must cost more, and seconds off the line of the anchors.
PREFIX_COST, PATH_COST, APART, OFF = 0.70, 0.90, 0.16, 0.60
#: Pulses that a fitted beat may be, and its tolerance.
PULSES, PULSE_OFF = (0.5, 2 / 3, 1.0, 1.5, 2.0), 0.2
#: Starts of one block.
BLOCK = 4096


def _costs(heard: float, written: np.ndarray) -> np.ndarray:
    apart = np.abs(written - heard)
    return np.fmin(2.5, np.fmin(apart, np.abs(apart - 12) + OCTAVE)) + 0 * written  # not a number where there is no note


def band_of(n: int) -> int:
    return max(4, n // 3)


def programme(heard: np.ndarray, written: np.ndarray, starts: np.ndarray, width: int, moves: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Costs after the last event of each start, by the note it lands on: [start, b + note - event], and the moves if asked for.

    The first event meets the first note; each further one meets a note, is
    extra, or notes are skipped before it. Cells off the diagonal by more than
    the band, or beyond ``width`` notes, are infinite.
    """
    n, b = len(heard), band_of(len(heard))
    off = np.arange(-b, b + 1)
    padded = np.concatenate([np.full(b + 1, np.nan), written, np.full(n + b + 1, np.nan)])
    reach = np.lib.stride_tricks.sliding_window_view(padded, 2 * b + 1)
    best = np.full((len(starts), 2 * b + 1), np.inf)
    best[:, b] = _costs(heard[0], written[starts])
    back = np.zeros((n + 1, 2 * b + 1), dtype=np.int8) if moves else None
    if moves:
        back[1, b] = 1
    for i in range(2, n + 1):
        cost = _costs(heard[i - 1], reach[starts + i])
        note = i + off
        met = best + cost
        extra = np.full_like(best, np.inf)
        extra[:, :-1] = best[:, 1:] + EXTRA
        extra[:, note == 1] = np.inf
        base = np.where(np.isnan(cost) | (note < 1) | (note > width), np.inf, np.minimum(met, extra))
        run = np.minimum.accumulate(base - SKIP * off, axis=1) + SKIP * off
        if moves:
            back[i] = np.where(run[0] < base[0] - 1e-12, 3, np.where(extra[0] < met[0], 2, 1))
        best = np.where(np.isnan(cost) | (note < 1) | (note > width), np.inf, run)
    return best, back


def _landed(best: np.ndarray, n: int, least: int) -> np.ndarray:
    """The costs with those that land on a note before the ``least``-th infinite."""
    note = n + np.arange(best.shape[1]) - (best.shape[1] - 1) // 2
    return np.where(note >= least, best, np.inf)


def prefix_costs(heard: DataFrame, written: DataFrame, keys: list[str], *, most: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """(start, cost): the mean cost of the first ``most`` events (i, pitch) from each note (k, pitch) that the first one can be.

    Numbers i and k count from 0. A start that leaves too few notes has none.
    """
    reach = 2 * most + 4
    # A note goes to its own block, and to those before whose last starts reach it.
    blocks = F.sequence(F.greatest(F.lit(0), F.floor((F.col("k") - reach) / block)), F.floor(F.col("k") / block))
    dealt = written.select(*keys, "k", "pitch", F.explode(blocks).alias("block"))
    head = heard.where(F.col("i") < most).select(*keys, "i", "pitch").join(dealt.select(*keys, "block").distinct(), keys)
    spec = T.StructType([*(written.schema[k] for k in keys), T.StructField("start", T.LongType()), T.StructField("cost", T.DoubleType())])

    def fold(key, a, b):
        if not len(a) or not len(b):
            return []
        a, b = a.sort_values("i"), b.sort_values("k")
        x, y, k = a["pitch"].to_numpy(float), b["pitch"].to_numpy(float), b["k"].to_numpy()
        n, least = len(x), max(6, int(len(x) * 0.65))
        apart = np.abs(y - x[0])
        own = k // block == key[-1]
        left = np.minimum(2 * n + 4, len(y) - np.arange(len(y)))
        starts = np.flatnonzero(own & (np.minimum(apart, np.abs(apart - 12)) <= OPENING) & (left >= least))
        best, _ = programme(x, y, starts, 2 * n + 4)
        cost = np.round(_landed(best, n, least).min(axis=1) / n, 9)
        ok = np.isfinite(cost)
        return [(*key[:-1], at, c) for at, c in zip(k[starts[ok]].tolist(), cost[ok].tolist())]

    return cogroup(head, dealt, [*keys, "block"], fold, spec)


def _numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)


def _verdicts(costs: DataFrame, sizes: DataFrame, keys: list[str], dearest: float) -> DataFrame:
    """(start, cost, runner_up, located) of each key of ``sizes`` (n): the cheapest start, unless another place is about as cheap."""
    best = costs.groupBy(*keys).agg(F.min(F.struct("cost", "start")).alias("b"), F.collect_list(F.struct("start", "cost")).alias("all"))
    distinct = F.greatest(F.lit(3), F.floor(F.col("n") / 3))
    other = F.array_min(F.transform(F.filter("all", lambda c: F.abs(c["start"] - F.col("b.start")) > distinct), lambda c: c["cost"]))
    tied = F.exists("all", lambda c: (c["start"] != F.col("b.start")) & (F.abs(c["cost"] - F.col("b.cost")) <= 1e-8))
    found = sizes.join(best, keys, "left").withColumns({"runner_up": other, "tied": F.coalesce(tied, F.lit(False))})
    sure = (F.col("n") >= FEWEST) & (F.col("b.cost") <= dearest) & (F.coalesce("runner_up", F.lit(float("inf"))) - F.col("b.cost") >= APART) & ~F.col("tied")
    return found.select(*keys, F.when(sure, F.col("b.start")).alias("start"), F.col("b.cost").alias("cost"), "runner_up", F.coalesce(sure, F.lit(False)).alias("located"))


def locate(heard: DataFrame, written: DataFrame, keys: list[str], seq: str, value: str, *, most: int = PREFIX, short: int = 24) -> DataFrame:
    """Where in the written sequence an excerpt starts: (start, cost, runner_up, located).

    Every start is tried, so an excerpt that fits two places is refused: located
    is false, and start null. Where more than ``short`` events were heard, their
    first ones alone must not be found elsewhere. Fewer than eight events or
    notes locate nothing. Costs are rounded to three digits.
    """
    a = _numbered(heard.select(*keys, F.col(seq).alias("_s"), F.col(value).cast("double").alias("pitch")), keys, ["_s"], "i").where(F.col("i") < most)
    b = _numbered(written.select(*keys, F.col(seq).alias("_s"), F.col(value).cast("double").alias("pitch")), keys, ["_s"], "k")
    enough = b.groupBy(*keys).count().where(F.col("count") >= FEWEST).select(*keys)
    b = b.join(enough, keys, "left_semi")
    sizes = a.groupBy(*keys).agg(F.count("*").alias("n"))
    full = _verdicts(prefix_costs(a, b, keys, most=most), sizes, keys, PREFIX_COST)
    first = a.join(sizes.where(F.col("n") > short), keys, "left_semi").where(F.col("i") < short)
    brief = _verdicts(prefix_costs(first, b, keys, most=short), first.groupBy(*keys).agg(F.count("*").alias("n")), keys, PREFIX_COST)
    brief = brief.where("located").select(*keys, F.col("start").alias("_brief"))
    both = full.join(brief, keys, "left").withColumn("located", F.col("located") & ~F.coalesce(F.col("_brief") != F.col("start"), F.lit(False)))
    return both.select(*keys, F.when(F.col("located"), F.col("start")).alias("start"), F.round("cost", 3).alias("cost"), F.round("runner_up", 3).alias("runner_up"), "located")


def whole_paths(heard: DataFrame, written: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(start, cost, end, pairs): of each start (keys, start, n) the cheapest path of all events, and what met what (k, i).

    Notes beyond the band of the last event are never read.
    """
    spec = T.StructType([*(starts.schema[k] for k in keys), T.StructField("start", T.LongType()), T.StructField("cost", T.DoubleType()), T.StructField("end", T.LongType()), T.StructField("pairs", T.ArrayType(T.StructType([T.StructField("k", T.LongType()), T.StructField("i", T.LongType())])))])
    asked = starts.select(*keys, "start", "n")
    a = heard.select(*keys, "i", "pitch").join(asked.select(*keys, "start"), keys)
    last = F.col("start") + F.col("n") + F.greatest(F.lit(4), F.floor(F.col("n") / 3))
    b = written.select(*keys, "k", "pitch").join(asked, keys).where(F.col("k").between(F.col("start"), last)).select(*keys, "start", "k", "pitch")

    def fold(key, x, y):
        x, y = x.sort_values("i")["pitch"].to_numpy(float), y.sort_values("k")["pitch"].to_numpy(float)
        if len(x) < 2 or len(y) < FEWEST:
            return []
        n, b = len(x), band_of(len(x))
        best, back = programme(x, y, np.zeros(1, dtype=int), len(y), moves=True)
        ends = _landed(best, n, max(4, n // 10))[0]
        at = int(np.argmin(ends))
        if not np.isfinite(ends[at]):
            return []
        i, d, pairs = n, at, []
        while i > 0 and i + d - b > 0:
            move = back[i, d]
            if move == 1:
                pairs.append({"k": int(key[-1] + i + d - b - 1), "i": int(i - 1)})
                i -= 1
            elif move == 2:
                i, d = i - 1, d + 1
            else:
                d -= 1
        return [(*key, round(float(ends[at]) / n, 9), int(key[-1] + n + at - b - 1), pairs[::-1])]

    return cogroup(a, b, [*keys, "start"], fold, spec)


def line(x: np.ndarray, y: np.ndarray, apart: float = 2.0, least: float = 0.5) -> tuple[float, float] | None:
    """(slope, level): the median slope of points at least so far apart, or that of both ends, and the median of the rest."""
    far = np.subtract.outer(x, x)
    i, j = np.nonzero(far >= apart)
    if len(i):
        slope = float(np.median((y[i] - y[j]) / far[i, j]))
    elif len(x) and x[-1] - x[0] >= least:
        slope = float((y[-1] - y[0]) / (x[-1] - x[0]))
    else:
        return None
    return slope, float(np.median(y - slope * x))


def _off_neighbours(x: np.ndarray, y: np.ndarray, around: int) -> np.ndarray:
    """How far each point lies off the least-squares line of its neighbours on either side, itself left out."""
    n = len(x)
    own = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    w = ((own > 0) & (own <= around)).astype(float)
    count = w.sum(1)
    mx, my = w @ x / count, w @ y / count
    dx, dy = x[None, :] - mx[:, None], y[None, :] - my[:, None]
    slope = (w * dx * dy).sum(1) / (w * dx * dx).sum(1)
    return np.abs(y - my - slope * (x - mx))


def anchors_of(x: np.ndarray, y: np.ndarray, around: int = 3, least: float = 0.12, times: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Points that rise in both: one a beat, at its median time, without those far off the line of their neighbours (two passes)."""
    at = pd.Series(y).groupby(x).median()
    x, y = at.index.to_numpy(float), at.to_numpy(float)
    for _ in range(2):
        if len(x) < 5:
            break
        off = _off_neighbours(x, y, around)
        good = off <= max(least, times * float(np.median(off)))
        if good.all():
            break
        x, y = x[good], y[good]
    rising, top = [], -np.inf
    for k, t in enumerate(y.tolist()):
        if t > top + 1e-3:
            rising.append(k)
            top = t
    return (x[rising], y[rising]) if len(rising) > 1 else (x[:0], y[:0])


def time_of(beat, x: np.ndarray, y: np.ndarray, slope: float):
    """Between anchors in proportion, beyond them by the slope."""
    beat = np.asarray(beat, dtype=float)
    return np.interp(beat, x, y) + slope * (np.minimum(beat - x[0], 0) + np.maximum(beat - x[-1], 0))


def _judged(n: int, pairs: pd.DataFrame, measures: pd.DataFrame, pulse: float | None) -> dict:
    """What an excerpt's pairs (k, i, beat, length, t, stop), in order, and the first beats of its notes (k, measure, beat) say."""
    fit = line(pairs["beat"].to_numpy(float), pairs["t"].to_numpy(float))
    heard = pairs["i"].nunique()
    out: dict = {"matched": len(pairs), "coverage": round(heard / n, 3), "end": int(pairs["k"].max()), "boundary": False, "trimmed": None, "end_t": None, "residual_ms": None, "slope": None, "t0": None, "measures": []}
    if fit is None:
        return out | {"confident": False, "first_t": float(pairs["t"].iloc[0]), "last_t": float(pairs["stop"].iloc[-1])}
    slope, level = fit
    off = float(np.median(np.abs(pairs["t"] - level - slope * pairs["beat"])))
    sure = 0.15 <= slope <= 2.0 and off <= OFF and len(pairs) >= FEWEST and heard / n >= 0.5
    sure = sure and (pulse is None or any(abs(slope / pulse - r) / r <= PULSE_OFF for r in PULSES))
    x, y = anchors_of(pairs["beat"].to_numpy(float), pairs["t"].to_numpy(float))
    if len(x):
        near = np.abs(time_of(pairs["beat"], x, y, slope) - pairs["t"].to_numpy(float)) <= OFF
        kept = int(np.max(np.flatnonzero(near), initial=-1)) + 1
        if len(pairs) >= 16 and near[0] and max(FEWEST, len(pairs) // 2) <= kept < len(pairs):
            # What runs on beyond the notation says nothing of it.
            pairs, near = pairs.iloc[:kept], near[:kept]
            out |= {"end": int(pairs["k"].max()), "trimmed": round(float(pairs["t"].iloc[-1]), 3)}
        head = pairs.iloc[0]
        begin, over = time_of([head["beat"], head["beat"] + head["length"]], x, y, slope)
        # A take that starts within a note can't show where the note began.
        cut = begin <= 0.05 and begin <= head["t"] < over
        out["boundary"] = bool((near[0] or cut) and near[-1])
        if out["boundary"]:
            out["end_t"] = round(float(time_of(measures.loc[measures["k"] == out["end"], "until"].iloc[0], x, y, slope)), 3)
    firsts = measures[measures["k"] <= out["end"]].groupby("measure")["beat"].first()
    times = time_of(firsts, x, y, slope) if len(x) else level + slope * firsts.to_numpy(float)
    out["measures"] = [{"measure": int(m), "t": round(float(t), 3)} for m, t in zip(firsts.index, np.atleast_1d(times))]
    return out | {"residual_ms": int(round(off * 1000)), "slope": round(slope, 4), "t0": round(level, 3), "confident": bool(sure and out["boundary"]), "first_t": float(pairs["t"].iloc[0]), "last_t": float(pairs["stop"].iloc[-1])}


_ANSWER = "start long, end long, cost double, runner_up double, refused string, matched long, coverage double, slope double, t0 double, residual_ms long, confident boolean, boundary boolean, trimmed double, end_t double, first_t double, last_t double, measures array<struct<measure: long, t: double>>"


def align_excerpt(heard: DataFrame, written: DataFrame, keys: list[str], *, pulses: DataFrame | None = None, most: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """One row for each take: where its events (start, stop, pitch) begin and end in a written line (beat, length, measure, pitch).

    The line's notes are numbered from 0 in order of beat. Returns start and end
    (notes), cost and runner_up of their paths, ``refused`` (``short``: too few
    events or notes, ``unlike``, ``ambiguous``; else null), matched, coverage
    (share of events that met a note), slope (seconds a beat) and t0 of one
    robust line, residual_ms, ``confident``, ``boundary`` (both ends lie on the
    anchors' line), ``trimmed`` (the last time kept, where a tail off that line
    was dropped), end_t, first_t, last_t and each measure's time. A refused
    take has nulls. ``pulses`` may give a steady beat's interval (keys, pulse),
    of which the slope must be a common multiple.
    """
    a = _numbered(usable_events(heard.select(*keys, "start", "stop", F.col("pitch").cast("double").alias("pitch")), keys), keys, ["start", "pitch"], "i")
    b = _numbered(written.select(*keys, "beat", "length", "measure", F.col("pitch").cast("double").alias("pitch")), keys, ["beat", "pitch"], "k")
    notes = b.groupBy(*keys).agg(F.count("*").alias("notes"))
    sizes = heard.select(*keys).distinct().join(a.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").join(notes, keys, "left").fillna(0, ["n", "notes"])
    fit = sizes.where((F.col("n") >= FEWEST) & (F.col("notes") >= FEWEST)).select(*keys, "n")
    w = Window.partitionBy(*keys)
    tried = prefix_costs(a.join(fit.select(*keys), keys, "left_semi"), b, keys, most=most, block=block)
    tried = tried.withColumns({"_best": F.min("cost").over(w), "_r": F.row_number().over(w.orderBy("cost", "start"))})
    starts = tried.where((F.col("cost") <= F.col("_best") + MARGIN) & (F.col("_r") <= SURVIVORS)).join(fit, keys).select(*keys, "start", "n")
    paths = whole_paths(a, b, starts, keys)
    # SURVIVORS rows a take.
    held = paths.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cost", "start", "end", "pairs"))).alias("p"))
    first = F.get(F.col("p"), F.lit(0))
    distinct = F.greatest(F.lit(3), F.floor(F.col("n") / 3))
    told = sizes.join(held, keys, "left").withColumns({
        "start": first["start"], "cost": first["cost"], "pairs": first["pairs"],
        "runner_up": F.array_min(F.transform(F.filter("p", lambda c: F.abs(c["start"] - first["start"]) > distinct), lambda c: c["cost"])),
        "tied": F.coalesce(F.exists("p", lambda c: (c["start"] != first["start"]) & (F.abs(c["cost"] - first["cost"]) <= 1e-8)), F.lit(False)),
    }).drop("p")
    close = F.coalesce(F.col("runner_up") - F.col("cost") < APART, F.lit(False)) | F.col("tied")
    told = told.withColumn("refused", F.when(F.col("cost").isNull(), "short").when(F.col("cost") > PATH_COST, "unlike").when(close, "ambiguous").when(F.size("pairs") == 0, "unlike"))
    good = told.where("refused IS NULL")
    met = good.select(*keys, F.explode("pairs").alias("_p")).select(*keys, "_p.k", "_p.i").join(a.select(*keys, "i", F.col("start").alias("t"), "stop"), [*keys, "i"]).join(b.select(*keys, "k", "beat", "length"), [*keys, "k"])
    met = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "i", "beat", "length", "t", "stop"))).alias("met"))
    ends = good.select(*keys, F.col("start").alias("_a"), F.element_at("pairs", -1)["k"].alias("_z"))
    span = b.join(ends, keys).where(F.col("k").between(F.col("_a"), F.col("_z"))).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "measure", "beat", (F.col("beat") + F.col("length")).alias("until")))).alias("span"))
    every = told.join(met, keys, "left").join(span, keys, "left")
    every = every.join(pulses.select(*keys, "pulse"), keys, "left") if pulses is not None else every.withColumn("pulse", F.lit(None).cast("double"))
    return _decided(every.select(*keys, "n", "start", "cost", "runner_up", "refused", "met", "span", "pulse"), keys)


def _decided(rows: DataFrame, keys: list[str]) -> DataFrame:
    ready(rows.sparkSession)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *T.StructType.fromDDL(_ANSWER).fieldNames()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                answer = {k: r[k] for k in keys} | {"refused": r["refused"], "cost": None if pd.isna(r["cost"]) else round(r["cost"], 3), "runner_up": None if pd.isna(r["runner_up"]) else round(r["runner_up"], 3)}
                if not isinstance(r["refused"], str):
                    pulse = None if r["pulse"] is None or pd.isna(r["pulse"]) else float(r["pulse"])
                    answer |= {"start": int(r["start"])} | _judged(int(r["n"]), pd.DataFrame(list(r["met"])), pd.DataFrame(list(r["span"])), pulse)
                out.append(answer)
            made = pd.DataFrame(out).reindex(columns=names)
            made["measures"] = pd.Series([m if isinstance(m, list) else None for m in made["measures"]], dtype=object)
            ints = ["start", "end", "matched", "residual_ms"]
            yield made.astype({**{c: "Int64" for c in ints}, "confident": "boolean", "boundary": "boolean", **{c: "float64" for c in ("cost", "runner_up", "coverage", "slope", "t0", "trimmed", "end_t", "first_t", "last_t")}})

    return rows.mapInPandas(run, f"{kinds}, {_ANSWER}")


def interval_of_beats(beats: Column) -> Column:
    """The median interval of sorted distinct beat times, where they are steady: at least four, none over 2.5 times it; else null."""
    gaps = F.transform(F.slice(beats, F.lit(2), F.greatest(F.size(beats) - 1, F.lit(0))), lambda b, i: b - F.get(beats, i))
    ordered = F.array_sort(gaps)
    middle = (F.get(ordered, F.floor((F.size(ordered) - 1) / 2).cast("int")) + F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))) / 2
    return F.when((F.size(beats) >= 4) & (middle > 0) & (F.array_max(gaps) <= 2.5 * middle), middle)
