"""Matching: as-of, nearest, interval, interpolation and one-to-one joins.

As-of joins are a union of both sides and one window: a single exchange on the
keys, no range join. Interval joins deal intervals out to equal buckets of the
axis, so that the join has an equality to hash on and a hot key is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cogroup


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, value: str, name: str, *, forward: bool = False, strict: bool = False) -> DataFrame:
    """Adds the value of the last right row at or before each left row
    (``strict``: before; ``forward``: the first at or after), else null."""
    side = left.columns
    l = left.select(*(F.col(c) for c in side), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.col(left_on).alias("_t"), F.lit(0 if strict != forward else 1).alias("_side"), F.lit(True).alias("_left"))
    r = right.select(*(F.col(k) if k in keys else F.lit(None).cast(left.schema[k].dataType).alias(k) for k in side), F.col(value).alias("_v"), F.col(right_on).alias("_t"), F.lit(1 if strict != forward else 0).alias("_side"), F.lit(False).alias("_left"))
    # Forward is backward in the other order: a frame that grows costs one step a row, one that shrinks is made anew for each.
    order = [F.desc("_t"), F.desc("_side")] if forward else ["_t", "_side"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(~F.col("_left"), F.struct("_v")), ignorenulls=True).over(w)
    return l.unionByName(r).withColumn(name, found["_v"]).where("_left").select(*side, name)


def interpolate(points: DataFrame, anchors: DataFrame, keys: list[str], x: str, anchor_x: str, anchor_y: str, slope: Column | None = None) -> DataFrame:
    """Adds ``y``: the line between the anchors around each point; beyond the
    outer anchors the slope given (or none: the outer anchor's value)."""
    w = Window.partitionBy(*keys).orderBy(anchor_x)
    a = anchors.select(*keys, F.struct(F.col(anchor_x).cast("double").alias("x"), F.col(anchor_y).cast("double").alias("y"), F.lead(F.col(anchor_x).cast("double")).over(w).alias("nx"), F.lead(F.col(anchor_y).cast("double")).over(w).alias("ny")).alias("a"), F.col(anchor_x).alias("_ax"))
    first = anchors.groupBy(*keys).agg(F.min(anchor_x).cast("double").alias("_x0"), F.min_by(anchor_y, anchor_x).cast("double").alias("_y0"))
    held = asof(points, a, keys, x, "_ax", "a", "_a").join(first, keys, "left")
    beyond = slope if slope is not None else F.lit(0.0)
    p = F.col(x).cast("double")
    y = (
        F.when(F.col("_a").isNull(), F.col("_y0") + (p - F.col("_x0")) * beyond)
        .when(F.col("_a.nx").isNull(), F.col("_a.y") + (p - F.col("_a.x")) * beyond)
        .otherwise(F.col("_a.y") + (F.col("_a.ny") - F.col("_a.y")) * (p - F.col("_a.x")) / (F.col("_a.nx") - F.col("_a.x")))
    )
    return held.withColumn("y", y).drop("_a", "_x0", "_y0")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, name: str, within: Column | float | None = None) -> DataFrame:
    """Adds the right value nearest to each left one (ties: the earlier), if it is near enough."""
    back = asof(left, right, keys, left_on, right_on, right_on, "_b")
    both = asof(back, right, keys, left_on, right_on, right_on, "_f", forward=True)
    down, up = F.col(left_on) - F.col("_b"), F.col("_f") - F.col(left_on)
    best = F.when(F.col("_b").isNull(), F.col("_f")).when(F.col("_f").isNull(), F.col("_b")).when(down <= up, F.col("_b")).otherwise(F.col("_f"))
    out = both.withColumn(name, best)
    if within is not None:
        out = out.withColumn(name, F.when(F.abs(F.col(name) - F.col(left_on)) <= within, F.col(name)))
    return out.drop("_b", "_f")


def _buckets(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of intervals (start, stop, id) that overlap, each pair once.

    Both sides are dealt out to buckets of ``width``; a pair that shares several
    is kept in the one where the later of the two starts.
    """
    l = left.select(*keys, F.col("id").alias("left_id"), F.col("start").alias("ls"), F.col("stop").alias("le"), _buckets(F.col("start"), F.col("stop"), width).alias("_b"))
    r = right.select(*keys, F.col("id").alias("right_id"), F.col("start").alias("rs"), F.col("stop").alias("re"), _buckets(F.col("start"), F.col("stop"), width).alias("_b"))
    both = l.join(r, [*keys, "_b"]).where((F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")))
    return both.where(F.col("_b") == F.floor(F.greatest("ls", "rs") / width)).drop("_b")


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Of each left interval, the right one with the largest overlap (ties: nearest start, then id)."""
    pairs = overlap_pairs(left, right, keys, width)
    overlap = F.least("le", "re") - F.greatest("ls", "rs")
    best = pairs.groupBy(*keys, "left_id").agg(F.max(F.struct(overlap.alias("overlap"), (-F.abs(F.col("ls") - F.col("rs"))).alias("near"), (-F.col("right_id")).alias("id"))).alias("m"))
    return best.select(*keys, "left_id", (-F.col("m.id")).alias("right_id"), F.col("m.overlap").alias("overlap"))


def overlap_or_nearest(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """``best_overlap`` for every left interval: one without any overlap has the right interval
    whose start is nearest (ties: the earlier; of equal starts the smallest id), with overlap 0."""
    found = best_overlap(left, right, keys, width)
    alone = left.join(found.select(*keys, F.col("left_id").alias("id")), [*keys, "id"], "left_anti")
    starts = right.groupBy(*keys, F.col("start").alias("_s")).agg(F.min("id").alias("right_id"))
    near = nearest(alone.select(*keys, "id", "start"), starts.select(*keys, "_s"), keys, "start", "_s", "_s").join(starts, [*keys, "_s"])
    return found.unionByName(near.select(*keys, F.col("id").alias("left_id"), "right_id", F.lit(0).cast(found.schema["overlap"].dataType).alias("overlap")))


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, label: str, *, nearest_middle: bool = False) -> DataFrame:
    """Adds the label of the interval [start, stop) a point is in; of several the last to start. Intervals of a key don't nest.

    With ``nearest_middle`` a point in none has the label of the interval whose middle is nearest (ties: the earlier).
    """
    held = intervals.select(*keys, "start", F.struct("stop", F.col(label).alias("label")).alias("_i"))
    found = asof(points, held, keys, at, "start", "_i", "_i")
    inside = F.when(F.col(at) < F.col("_i.stop"), F.col("_i.label"))
    if not nearest_middle:
        return found.withColumn(label, inside).drop("_i")
    middles = intervals.groupBy(*keys, ((F.col("start") + F.col("stop")) / 2).alias("_m")).agg(F.min(label).alias("_label"))
    back = asof(found, middles.select(*keys, "_m", F.struct("_m", "_label").alias("_b")), keys, at, "_m", "_b", "_b")
    both = asof(back, middles.select(*keys, "_m", F.struct("_m", "_label").alias("_f")), keys, at, "_m", "_f", "_f", forward=True)
    earlier = F.col("_f").isNull() | (F.col(at) - F.col("_b._m") <= F.col("_f._m") - F.col(at))
    return both.withColumn(label, F.coalesce(inside, F.when(earlier, F.col("_b._label")).otherwise(F.col("_f._label")), F.col("_f._label"))).drop("_i", "_b", "_f")


def fused(frames: DataFrame, notes: DataFrame, keys: list[str], at: str, own: str, trust: str, *, sure: float = 0.7, borrowed: float = 0.9) -> DataFrame:
    """Adds ``pitch`` and ``confidence`` of frames: their own reading where it is sure, else that of the
    note (start, stop, note) around them, else nothing. Notes of a key don't overlap."""
    held = containing(frames, notes, keys, at, "note")
    keep = F.col(own).isNotNull() & (F.col(trust) >= sure)
    return held.withColumns({"pitch": F.when(keep, F.col(own)).otherwise(F.col("note")), "confidence": F.when(keep, F.col(trust)).when(F.col("note").isNotNull(), borrowed).otherwise(0.0)}).drop("note")


def mutual_nearest(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """One-to-one pairs (left.t, right.t): each is the other's nearest (ties: the earlier), within the tolerance.

    Both sides are one union: of each row the other side's last at or before it
    and first at or after it come from one exchange, and a pair is one that both
    sides name.
    """
    both = left.select(*keys, "t", F.lit(True).alias("_left")).unionByName(right.select(*keys, "t", F.lit(False).alias("_left")))
    up, down = (Window.partitionBy(*keys).orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in ("t", F.desc("t")))
    ours, theirs = F.when(F.col("_left"), F.col("t")), F.when(~F.col("_left"), F.col("t"))
    other = lambda w: F.when(F.col("_left"), F.last(theirs, ignorenulls=True).over(w)).otherwise(F.last(ours, ignorenulls=True).over(w))
    seen = both.withColumn("_b", other(up)).withColumn("_f", other(down))
    near = F.when(F.col("_b").isNull(), F.col("_f")).when(F.col("_f").isNull() | (F.col("t") - F.col("_b") <= F.col("_f") - F.col("t")), F.col("_b")).otherwise(F.col("_f"))
    close = seen.withColumn("_n", near).where(F.abs(F.col("_n") - F.col("t")) <= tolerance)
    named = close.select(*keys, F.when(F.col("_left"), F.col("t")).otherwise(F.col("_n")).alias("left_t"), F.when(F.col("_left"), F.col("_n")).otherwise(F.col("t")).alias("right_t"), "_left")
    return named.groupBy(*keys, "left_t", "right_t").agg(F.count_if("_left").alias("_l"), F.count_if(~F.col("_left")).alias("_r")).where("_l > 0 AND _r > 0").drop("_l", "_r")


def greedy_pairs(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """One-to-one pairs in order of the left times: each takes the nearest right time still free within the tolerance."""
    kinds = [left.schema[k] for k in keys]
    spec = T.StructType([*kinds, T.StructField("left_t", T.DoubleType()), T.StructField("right_t", T.DoubleType())])

    def fold(key, a, b):
        import pandas as pd

        free = sorted(b["t"].tolist())
        out = []
        for t in sorted(a["t"].tolist()):
            near = [x for x in free if abs(x - t) <= tolerance]
            if near:
                best = min(near, key=lambda x: (abs(x - t), x))
                free.remove(best)
                out.append((*key, t, best))
        return pd.DataFrame(out, columns=[*keys, "left_t", "right_t"])

    return cogroup(left.select(*keys, "t"), right.select(*keys, "t"), keys, fold, spec)


def monotone_onsets(notes: DataFrame, onsets: DataFrame, keys: list[str], reach: float = 0.22, share: float = 0.35, *, apart: float = 0.0, wide: tuple[float, float] | None = None) -> DataFrame:
    """Strict matching of notes (id, ref, dur) to onsets (t): in order, each
    takes the free onset nearest to its reference, more than ``apart`` after the
    last one taken and within min(reach, share * dur); else it keeps its reference.

    ``wide`` (reach, share) is tried where nothing is as near: up to that share of
    the note's own length late, and of the length before it early, so that no
    neighbour's onset is caught. A note that is far off still counts then."""
    kinds = [notes.schema[k] for k in keys]
    spec = T.StructType([*kinds, notes.schema["id"], T.StructField("onset", T.DoubleType()), T.StructField("matched", T.BooleanType())])

    def fold(key, a, b):
        import numpy as np
        import pandas as pd

        t = np.sort(b["t"].to_numpy(dtype=float))
        out, free, before = [], 0, None
        for r in a.sort_values(["ref", "id"]).itertuples(index=False):
            limit = min(reach, share * r.dur)
            tries = [(limit, limit)]
            if wide is not None:
                tries.append((min(wide[0], wide[1] * (r.dur if before is None else before)), min(wide[0], wide[1] * r.dur)))
            before = r.dur
            k = None
            for early, late in tries:
                lo, hi = max(free, int(np.searchsorted(t, r.ref - early, "left"))), int(np.searchsorted(t, r.ref + late, "right"))
                if lo < hi:
                    k = lo + int(np.argmin(np.abs(t[lo:hi] - r.ref)))
                    break
            if k is not None:
                free = max(k + 1, int(np.searchsorted(t, t[k] + apart, "right")))
                out.append((*key, r.id, float(t[k]), True))
            else:
                out.append((*key, r.id, float(r.ref), False))
        return pd.DataFrame(out, columns=[*keys, "id", "onset", "matched"])

    return cogroup(notes.select(*keys, "id", "ref", "dur"), onsets.select(*keys, "t"), keys, fold, spec)


def displaced(notes: DataFrame, keys: list[str], index: str, beat: str, heard: str, written: str, places: int = 4, beats: float = 6.0, tolerance: float = 0.5) -> DataFrame:
    """Adds ``moved_from``: the first neighbour within so many places and beats
    whose written value is what was heard here. Neighbours come by window, not by join."""
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(-places, places)
    around = F.collect_list(F.struct(F.col(index).alias("i"), F.col(beat).alias("b"), F.col(written).alias("p"))).over(w)
    fit = F.filter(around, lambda n: (n["i"] != F.col(index)) & (F.abs(n["b"] - F.col(beat)) <= beats) & (F.abs(n["p"] - F.col(heard)) <= tolerance))
    return notes.withColumn("moved_from", F.array_min(F.transform(fit, lambda n: n["i"])))


def unmatched(rows: DataFrame, matches: DataFrame, on: list[str]) -> DataFrame:
    """Rows that no match names."""
    return rows.join(matches.select(*on).distinct(), on, "left_anti")


def apart_from(rows: DataFrame, others: DataFrame, keys: list[str], at: str, other_at: str, gap: float) -> DataFrame:
    """Rows without any other within ``gap``."""
    near = nearest(rows, others.select(*keys, other_at), keys, at, other_at, "_near", gap)
    return near.where(F.col("_near").isNull()).drop("_near")


def masked_by_lower(notes: DataFrame, keys: list[str], onset: str, pitch: str, within: float = 0.08) -> DataFrame:
    """Adds ``masked``: a note 12, 19 or 24 lower starts within the time.

    Each note is also dealt out as what it may mask, to the pitches above it; a
    window over one pitch then finds the nearest of these on either side: one
    exchange, no join.
    """
    own = notes.select("*", F.col(pitch).alias("_p"), F.col(onset).alias("_o"), F.lit(True).alias("_note"))
    over = notes.select(*keys, F.explode(F.array(*(F.col(pitch) + d for d in (12, 19, 24)))).alias("_p"), F.col(onset).alias("_o"), F.lit(False).alias("_note"))
    up, down = (Window.partitionBy(*keys, "_p").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (("_o", "_note"), (F.desc("_o"), "_note")))
    cause = F.when(~F.col("_note"), F.col("_o"))
    before, after = (F.last(cause, ignorenulls=True).over(w) for w in (up, down))
    near = F.coalesce(F.col("_o") - before <= within, F.lit(False)) | F.coalesce(after - F.col("_o") <= within, F.lit(False))
    return own.unionByName(over, allowMissingColumns=True).withColumn("masked", near).where("_note").drop("_p", "_o", "_note")


def merge_plan(local: DataFrame, cloud: DataFrame, id_col: str, updated: str, most: int) -> DataFrame:
    """What to fetch: the newest cloud rows that aren't local, up to a number."""
    return cloud.join(local.select(id_col), id_col, "left_anti").orderBy(F.desc(updated), id_col).limit(most)


def grid_distance(t: Column, offset: Column | float, step: float) -> Column:
    """Distance to the nearest line of a regular grid."""
    phase = F.pmod(t - offset, F.lit(step))
    return F.least(phase, F.lit(step) - phase)


def two_stage_offset(grid: DataFrame, heard: DataFrame, keys: list[str], interval: float) -> DataFrame:
    """(offset, mean_ms, within_50ms): the shift of a grid of times that lies nearest to what was heard.

    Sixteenths of the interval up to half of it are tried first, then steps of
    1/64 from the best so far. A take's two lists are one group.
    """
    spec = T.StructType([*(grid.schema[k] for k in keys), *(T.StructField(n, T.DoubleType()) for n in ("offset", "mean_ms", "within_50ms"))])

    def fold(key, a, b):
        import numpy as np
        import pandas as pd

        beats, times = np.sort(a["t"].to_numpy(float)), b["t"].to_numpy(float)
        if len(beats) < 4 or not len(times):
            return pd.DataFrame([], columns=spec.fieldNames())

        def away(shift):
            place = np.searchsorted(beats, times - shift)
            return np.minimum(np.abs(times - shift - beats[np.maximum(place - 1, 0)]), np.abs(times - shift - beats[np.minimum(place, len(beats) - 1)]))

        mean, best = min((away(k * interval / 16).mean(), k * interval / 16) for k in range(-8, 9))
        for k in range(-16, 17):
            shift = best + k * interval / 64
            if (error := away(shift).mean()) < mean:
                mean, best = error, shift
        return pd.DataFrame([(*key, round(best, 4), round(mean * 1000, 1), round(float((away(best) <= 0.05).mean()), 3))], columns=spec.fieldNames())

    return cogroup(grid.select(*keys, "t"), heard.select(*keys, "t"), keys, fold, spec)


def grid_offset(times: DataFrame, keys: list[str], t: str, step: float, shifts: list[float]) -> DataFrame:
    """(shift, residual): of a regular grid's shifts, the one with the least median distance (to 3 decimals; ties: the first).

    A key's times are gathered once, and every shift is tried on that list.
    """
    middle = lambda x: (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2
    held = times.where(F.col(t).isNotNull()).groupBy(*keys).agg(F.collect_list(F.col(t).cast("double")).alias("_t"))
    away = lambda shift: F.array_sort(F.transform("_t", lambda x: grid_distance(x, shift, step)))
    tried = F.transform(F.array(*(F.lit(float(s)) for s in shifts)), lambda s: F.struct(F.round(F.element_at(F.transform(F.array(away(s)), middle), 1), 3).alias("residual"), s.alias("shift")))
    return held.select(*keys, F.array_min(tried).alias("b")).select(*keys, "b.shift", "b.residual")
