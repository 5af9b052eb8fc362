"""Ordered operators: runs, gaps, folds, merging, smoothing, downsampling.

Each partitions by ``keys``. What compares with the neighbour row is a window;
what compares with the last *kept* row is an ordered fold inside the group,
done by the JVM's ``aggregate`` on a sorted list, so the group must be one take,
user or document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ready


def _w(keys: list[str], order: list[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def runs(df: DataFrame, keys: list[str], order: str, gap: float, *, ties: list[str] | None = None) -> DataFrame:
    """Adds ``run``: rows whose order value is within ``gap`` of the one before are one run."""
    w = _w(keys, [order, *(ties or [])])
    starts = F.when(F.col(order) - F.lag(order).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", starts).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def dense_runs(df: DataFrame, keys: list[str], order: str, gap: float, least: int, measure: str | None = None, measures: int = 1) -> DataFrame:
    """Runs of ``least`` rows in ``measures`` distinct measures: their ends and size."""
    held = runs(df, keys, order, gap).groupBy(*keys, "run")
    aggs = [F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")]
    out = held.agg(*aggs, F.count_distinct(measure or order).alias("measures"))
    return out.where((F.col("n") >= least) & (F.col("measures") >= measures)).select(*keys, "first", "last", "n", "measures")


def range_text(items: Column) -> Column:
    """Sorted distinct integers as "3-5, 9", by one fold."""
    state = "struct<lo:int,hi:int,text:string>"
    part = lambda s: F.when(s["lo"] == s["hi"], s["lo"].cast("string")).otherwise(F.concat(s["lo"].cast("string"), F.lit("-"), s["hi"].cast("string")))
    closed = lambda s: F.when(s["lo"].isNull(), s["text"]).when(s["text"] == "", part(s)).otherwise(F.concat(s["text"], F.lit(", "), part(s)))
    begin = F.struct(F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit("").alias("text")).cast(state)
    step = lambda s, x: F.when(x == s["hi"] + 1, F.struct(s["lo"].alias("lo"), x.alias("hi"), s["text"].alias("text"))).otherwise(F.struct(x.alias("lo"), x.alias("hi"), closed(s).alias("text"))).cast(state)
    return F.aggregate(F.transform(F.array_sort(F.array_distinct(items)), lambda x: x.cast("int")), begin, step, closed)


def kept_apart(times: Column, gap: float) -> Column:
    """Of sorted times, those more than ``gap`` after the last one kept."""
    step = lambda kept, t: F.when((F.size(kept) == 0) | (t > F.try_element_at(kept, F.lit(-1)) + gap), F.concat(kept, F.array(t))).otherwise(kept)
    return F.aggregate(times, F.array().cast("array<double>"), step)


def dedupe_onsets(df: DataFrame, keys: list[str], time: str, gap: float) -> DataFrame:
    """Onsets of each group with near followers dropped; ``t`` ascending."""
    held = df.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(time).cast("double"))).alias("ts"))
    return held.select(*keys, F.explode(kept_apart(F.col("ts"), gap)).alias("t"))


def clusters(df: DataFrame, keys: list[str], time: str, gap: float, span: float) -> DataFrame:
    """Clusters of times: a time joins while it is within ``gap`` of the one
    before and within ``span`` of its cluster's first. (start, stop, n)."""
    state = "array<struct<start:double,stop:double,n:int>>"

    def step(s: Column, t: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        joins = (F.size(s) > 0) & (t - last["stop"] <= gap) & (t - last["start"] <= span)
        grown = F.struct(last["start"].alias("start"), t.alias("stop"), (last["n"] + 1).alias("n"))
        fresh = F.struct(t.alias("start"), t.alias("stop"), F.lit(1).alias("n"))
        return F.when(joins, F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(s, F.array(fresh))).cast(state)

    held = df.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(time).cast("double"))).alias("ts"))
    return held.select(*keys, F.explode(F.aggregate("ts", F.array().cast(state), step)).alias("c")).select(*keys, "c.start", "c.stop", "c.n")


def increasing(pairs: Column, epsilon: float, seconds: float | None = None) -> Column:
    """Of (beat, sec) pairs in order, those that advance both by more than epsilon (the second by ``seconds``, if given)."""
    later = epsilon if seconds is None else seconds
    kind = "array<struct<beat:double,sec:double>>"
    last = lambda s: F.try_element_at(s, F.lit(-1))
    step = lambda s, p: F.when((F.size(s) == 0) | ((p["beat"] > last(s)["beat"] + epsilon) & (p["sec"] > last(s)["sec"] + later)), F.concat(s, F.array(p))).otherwise(s).cast(kind)
    return F.aggregate(pairs.cast(kind), F.array().cast(kind), step)


def silence_gaps(df: DataFrame, keys: list[str], time: str, least: float) -> DataFrame:
    """Gaps between neighbours longer than ``least``; nothing before the first or after the last."""
    nxt = F.lead(time).over(_w(keys, [time]))
    return df.withColumn("stop", nxt).where(F.col("stop") - F.col(time) > least).select(*keys, F.col(time).alias("start"), "stop")


def quiet_runs(df: DataFrame, keys: list[str], time: str, level: str, below: float, least: float) -> DataFrame:
    """Maximal runs of frames below a level that last longer than ``least``, away from the edges."""
    w = _w(keys, [time])
    quiet = F.coalesce(F.col(level) < below, F.lit(True))
    q = df.withColumn("quiet", quiet).withColumn("turn", F.sum(F.when(F.col("quiet") != F.coalesce(F.lag("quiet").over(w), ~F.col("quiet")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = q.groupBy(*keys, "turn", "quiet").agg(F.min(time).alias("start"), F.max(time).alias("stop"))
    edge = Window.partitionBy(*keys)
    ends = ends.withColumns({"lo": F.min("turn").over(edge), "hi": F.max("turn").over(edge)})
    return ends.where("quiet AND turn > lo AND turn < hi").where(F.col("stop") - F.col("start") > least).select(*keys, "start", "stop")


def merge_intervals(df: DataFrame, keys: list[str], start: str, stop: str, pad: Column | float = 0.0) -> DataFrame:
    """Overlapping or touching intervals as one, after padding both ends."""
    padded = df.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).select(*keys, (F.col(start) - pad).alias("start"), (F.col(stop) + pad).alias("stop")) if pad else df.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).select(*keys, F.col(start).alias("start"), F.col(stop).alias("stop"))
    w = _w(keys, ["start", "stop"])
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = padded.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("island")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Labels that never go back: the largest so far."""
    return df.withColumn(name, F.max(value).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def equal_grid(df: DataFrame, keys: list[str], start: str, stop: str, parts: int) -> DataFrame:
    """``parts`` equal steps of each span: (k from 0, t)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("k")
    out = df.select(*keys, F.col(start).alias("_a"), F.col(stop).alias("_b"), k)
    return out.select(*keys, "k", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("k") / parts).alias("t"))


def phrases(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Groups of ``size`` rows in order, numbered from 1."""
    n = F.row_number().over(_w(keys, [order]))
    return df.withColumn("phrase", (F.floor((n - 1) / size) + 1).cast("long"))


def edges(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def local_line(df: DataFrame, keys: list[str], x: str, y: str, half: int) -> DataFrame:
    """``smooth``: value at each row of the line through the rows within ``half`` of x, never falling."""
    w = _w(keys, [x]).rangeBetween(-half, half)
    n, slope = F.count(y).over(w), F.regr_slope(F.col(y), F.col(x)).over(w)
    mean_x, mean_y = F.avg(x).over(w), F.avg(y).over(w)
    spread = F.max(x).over(w) > F.min(x).over(w)
    line = F.when((n >= 2) & spread, mean_y + slope * (F.col(x) - mean_x)).otherwise(mean_y)
    fitted = df.withColumn("line", F.round(line, 6))
    return fitted.withColumn("smooth", F.max("line").over(_w(keys, [x]).rowsBetween(Window.unboundedPreceding, 0)))


def trailing_trend(df: DataFrame, keys: list[str], order: str, value: str, rows: int, reach: float) -> DataFrame:
    """``trend``: slope over the ``rows`` rows before, held within +-reach; null with fewer than 2."""
    w = _w(keys, [order]).rowsBetween(-rows, -1)
    slope = F.when(F.count(value).over(w) >= 2, F.regr_slope(F.col(value), F.col(order)).over(w))
    return df.withColumn("trend", F.when(slope.isNotNull(), F.least(F.lit(reach), F.greatest(F.lit(-reach), slope))))


def downsample(df: DataFrame, keys: list[str], order: str, value: str, buckets: int) -> DataFrame:
    """The row of the largest value in each of so many equal buckets of rows (ties: the first), and the bucket's size."""
    w = _w(keys, [order])
    n = F.count("*").over(Window.partitionBy(*keys))
    bucket = F.floor((F.row_number().over(w) - 1) * buckets / F.greatest(n, F.lit(buckets))).cast("long")
    rank = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(F.desc_nulls_last(value), F.asc(order)))
    size = F.count("*").over(Window.partitionBy(*keys, "bucket"))
    return df.withColumn("bucket", bucket).withColumns({"size": size, "_r": rank}).where("_r = 1").drop("_r")


def lineage(df: DataFrame, key: str, order: list[str], id_col: str) -> DataFrame:
    """attempt (from 1) within a key, and the id it retries."""
    w = _w([key], order)
    return df.withColumns({"attempt": F.row_number().over(w).cast("long"), "retries": F.lag(id_col).over(w)})


def renumber(df: DataFrame, keys: list[str], order: str, skipped: Column, first: int = 1) -> DataFrame:
    """Numbers that count only rows that aren't skipped; skipped rows have none."""
    n = F.sum(F.when(skipped, 0).otherwise(1)).over(_w(keys, [order]).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("number", F.when(~skipped, n + (first - 1)))


def segment_frames(frames: DataFrame, onsets: DataFrame, keys: list[str], time: str, value: str, least: float) -> DataFrame:
    """Events between neighbouring onsets: median value and count of their frames.

    A frame finds its onset by a running count over the union of both, so
    there is one exchange and no range join.
    """
    both = frames.select(*keys, F.col(time).alias("t"), F.col(value).cast("double").alias("v"), F.lit(1).alias("kind")).unionByName(onsets.select(*keys, "t", F.lit(None).cast("double").alias("v"), F.lit(0).alias("kind")))
    w = _w(keys, ["t", "kind"]).rowsBetween(Window.unboundedPreceding, 0)
    tagged = both.withColumn("segment", F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(w)).where("segment > 0")
    held = tagged.groupBy(*keys, "segment").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.median("v").alias("value"), F.count("v").alias("frames"))
    return held.where((F.col("stop") - F.col("start") >= least) & (F.col("frames") > 0)).select(*keys, "segment", "start", "stop", "value", "frames")


def mono(events: DataFrame, keys: list[str], window: float = 0.05, trim: float = 0.001) -> DataFrame:
    """Events (start, stop, pitch) with one voice: of those within a window of
    a group's first start the lowest; ends are cut before the next start.

    A task reads its keys (of plain types) as one sorted stream and holds the group
    that goes on, so neither a key's count of events nor the count of keys costs a call.
    """
    ready(events.sparkSession)
    spec = T.StructType([*(events.schema[k] for k in keys), T.StructField("start", T.DoubleType()), T.StructField("stop", T.DoubleType()), T.StructField("pitch", T.DoubleType())])
    numbers = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in ("start", "stop", "pitch")]
    order = [*keys, F.asc_nulls_last("start"), F.asc_nulls_last("pitch")]
    return events.select(*keys, *numbers).repartition(*keys).sortWithinPartitions(*order).mapInArrow(_voiced(keys, window, trim), spec)


def _voiced(keys: list[str], window: float, trim: float):
    """Sorted events -> those of one voice."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def voice(rows: pa.Table) -> pa.Table:
            """A row for each group; the last isn't cut yet."""
            new = np.zeros(len(rows), dtype=bool)
            for k in keys:
                codes = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            start, stop, pitch = (rows.column(c).to_numpy() for c in ("start", "stop", "pitch"))
            heads, lowest, head, low = [], [], None, None
            for k, (fresh, s, p) in enumerate(zip(new.tolist(), start.tolist(), pitch.tolist(), strict=True)):
                if head is None or fresh or s - head > window:
                    head, low = s, p
                    heads.append(k)
                    lowest.append(k)
                elif p < low:
                    low, lowest[-1] = p, k
            start, stop, nxt = start[heads], stop[lowest], start[heads[1:]] - trim
            stop[:-1] = np.where(~new[heads[1:]] & (nxt < stop[:-1]), nxt, stop[:-1])
            made = [pa.array(x, from_pandas=True) for x in (start, stop, pitch[lowest])]
            return pa.table([*(rows.column(k).take(pa.array(heads)) for k in keys), *made], schema=rows.schema)

        held = None  # the group that may go on, as one row
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not len(rows):
                continue
            made = voice(rows)
            held = made.slice(len(made) - 1)
            yield from made.slice(0, len(made) - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return run


def suppress(peaks: DataFrame, keys: list[str], place: str, strength: str, radius: float) -> DataFrame:
    """Peaks that survive stronger ones nearby: in order of strength, a peak
    goes if one that stays is within the radius."""
    ready(peaks.sparkSession)
    spec = T.StructType([*(peaks.schema[k] for k in keys), peaks.schema[place], peaks.schema[strength]])

    def fold(pdf):
        kept: list[float] = []
        keep = []
        for r in pdf.sort_values([strength, place], ascending=[False, True]).index:
            x = pdf.at[r, place]
            if all(abs(x - k) > radius for k in kept):
                kept.append(x)
                keep.append(r)
        return pdf.loc[sorted(keep)]

    return peaks.select(*keys, place, strength).groupBy(*keys).applyInPandas(fold, spec)


def resolved_pitch(notes: DataFrame, keys: list[str], order: list[str], step: Column, octave: str, printed: Column, signature: Column) -> DataFrame:
    """Adds ``alter`` and ``midi``: an accidental holds for its step and octave until the
    keys (a take's measure) end; without one the key signature counts, else nothing."""
    w = Window.partitionBy(*keys, "_step", octave).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    base = F.create_map(*(F.lit(v) for pair in {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}.items() for v in pair))
    held = notes.withColumns({"_step": step, "_printed": printed, "_signature": signature})
    held = held.withColumn("alter", F.coalesce(F.last("_printed", ignorenulls=True).over(w), "_signature", F.lit(0)))
    return held.withColumn("midi", (F.col(octave) + 1) * 12 + base[F.col("_step")] + F.col("alter")).drop("_step", "_printed", "_signature")


def rolled_chords(events: DataFrame, keys: list[str], *, together: float = 0.05, roll: float = 0.40, ring: float = 0.10, trim: float = 0.001) -> DataFrame:
    """Events (start, stop, pitch) as chords (start, stop, pitches): an event joins while it starts
    within ``together`` of the chord's start, or within ``roll`` and well before all of it has ended.
    A chord ends before the next starts."""
    ready(events.sparkSession)
    spec = T.StructType([*(events.schema[k] for k in keys), T.StructField("start", T.DoubleType()), T.StructField("stop", T.DoubleType()), T.StructField("pitches", T.ArrayType(T.DoubleType()))])

    def fold(key, pdf):
        import pandas as pd

        made: list[list] = []
        for r in pdf.sort_values(["start", "stop", "pitch"], kind="stable").itertuples(index=False):
            lead = r.start - made[-1][0] if made else float("inf")
            if made and (lead <= together or (lead <= roll and r.start < made[-1][1] - ring)):
                made[-1][1] = max(made[-1][1], r.stop)
                made[-1][2].add(r.pitch)
            else:
                made.append([r.start, r.stop, {r.pitch}])
        for a, b in zip(made, made[1:]):
            a[1] = min(a[1], b[0] - trim)
        return pd.DataFrame([(*key, a, b, sorted(p)) for a, b, p in made if b > a], columns=[*keys, "start", "stop", "pitches"])

    usable = events.where((F.col("stop") > F.col("start")) & F.col("pitch").isNotNull())
    return usable.select(*keys, "start", "stop", "pitch").groupBy(*keys).applyInPandas(fold, spec)


def loop_windows(starts: DataFrame, keys: list[str], time: str, bar: str, first: Column, last: Column, near: Column, *, lead_in: float = 0.15, least: float = 0.2) -> DataFrame:
    """(start, stop) that plays bars first..last once: of the passes, the one around ``near``,
    else the next after it, else the first. ``starts`` has a row for each time a bar starts."""
    w = Window.partitionBy(*keys).orderBy(time)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    t = starts.withColumns({"_next": F.lead(time).over(w), "_gap": F.col(time) - F.lag(time).over(w), "_from": first, "_to": last, "_near": near})
    closing = F.first(F.when(F.col(bar) == F.col("_to"), F.struct(F.col(time).alias("t"), F.col("_next").alias("next"), F.col("_gap").alias("gap"))), ignorenulls=True).over(ahead)
    t = t.withColumn("_k", closing).where((F.col(bar) == F.col("_from")) & F.col("_k").isNotNull())
    stop = F.coalesce(F.col("_k.next"), F.col("_k.t") + F.greatest(F.lit(0.5), F.coalesce(F.col("_k.gap"), F.lit(2.0))))
    passes = t.select(*keys, F.greatest(F.lit(0.0), F.col(time) - lead_in).alias("start"), stop.alias("stop"), "_near").where(F.col("stop") > F.col("start") + least)
    rank = F.when((F.col("_near") >= F.col("start")) & (F.col("_near") < F.col("stop")), 0).when(F.col("start") >= F.col("_near"), 1).otherwise(2)
    best = passes.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), "start", "stop")).alias("b"))
    return best.select(*keys, "b.start", "b.stop")
