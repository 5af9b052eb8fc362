"""What partials of a spectrum say: tones of a chord, whether a written or a heard tone sounds, second readings.

Recordings are cut into chunks, which meet the requests that reach into them block
by block of a take, so a long take is read by many tasks. The kernels see one
request's samples, which come to them in short runs, and return a few numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import dealt, ready

#: Cents around a partial that are searched, once its tone is known, and while it isn't; partials and the highest frequency.
SEARCH, REFINE, UNKNOWN, PARTIALS, TOP_HZ = 70.0, 20.0, 45.0, 10, 5000.0
#: Decibels of a peak over the floor, and under the loudest; cents that a known partial's place is blanked by; semitones that estimates agree within.
OVER, UNDER, BLANK, AGREE = 15.0, 50.0, 8.0, 0.25
#: Intervals at which a tone's partials all are a lower tone's.
WITHIN = (12, 19, 24, 31, 36)
#: Seconds ahead of a chord that a rolled one may begin, least seconds of a played tone, and of an edge of a take.
ROLL, SOUNDS, EDGE = 0.40, 0.10, 0.05
#: Fixed values of the check of two series: cents in doubt, weights of partials, tolerance, share that a series needs, decibels under the other, least seconds.
DOUBT, WEIGHTS, TOLERANCE, SERIES, RESIDUE, LEAST = 150.0, (1.0, 1.0, 0.8, 0.6, 0.5, 0.4), 60.0, 0.5, -10.0, 0.06
#: Fixed values of a second reading: strength of the written key, and cents beyond which it isn't taken.
STRENGTH, FAR = 0.3, 100.0


def hz(midi):
    return 440.0 * 2 ** ((np.asarray(midi, dtype=float) - 69) / 12)


def _ratio(cents: float) -> float:
    return 2 ** (cents / 1200) - 1


@dataclass(frozen=True)
class Spectra:
    """Frames of levels in decibels, with what a peak must reach in each."""

    step: float  # Hz of a bin
    db: np.ndarray  # [frame, bin]
    floor: np.ndarray
    need: np.ndarray
    resolution: float  # Hz
    top: float

    def band(self, centre: float, radius: float) -> np.ndarray:
        """Bins within the radius."""
        lo, hi = int(np.ceil((centre - radius) / self.step)), int(np.floor((centre + radius) / self.step))
        return np.arange(max(lo, 0), min(hi, self.db.shape[1] - 1) + 1)

    def peaks(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(frequency, decibels over the floor) of each frame's largest of these bins; not a number where it is no peak."""
        if not len(bins):
            return np.full(len(self.db), np.nan), np.full(len(self.db), np.nan)
        at = bins[self.db[:, bins].argmax(axis=1)][:, None]
        found, over = self._told(at, at >= 0)
        return found[:, 0], over[:, 0]

    def _told(self, at: np.ndarray, good: np.ndarray, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(frequency between bins, decibels over the floor) at [frame, peak] where it is good and loud enough; ``inner``: and over its neighbours."""
        rows = np.arange(len(self.db))[:, None]
        left, right = np.maximum(at - 1, 0), np.minimum(at + 1, self.db.shape[1] - 1)
        a, m, c = self.db[rows, left], self.db[rows, at], self.db[rows, right]
        bend = a - 2 * m + c
        shift = np.where((np.abs(bend) > 1e-9) & (left < at) & (at < right), 0.5 * (a - c) / np.where(np.abs(bend) > 1e-9, bend, 1.0), 0.0)
        good = good & (m >= self.need[:, None])
        if inner:
            good &= (m >= a) & (m >= c)
        return np.where(good, (at + np.minimum(np.maximum(shift, -0.5), 0.5)) * self.step, np.nan), np.where(good, m - self.floor[:, None], np.nan)

    def tops(self, centres: np.ndarray, radii: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``peaks`` of the free bins within each radius, all at once as [frame, centre]; each must stand out from its neighbours, and not at an end of the bins."""
        lo, hi = np.ceil((centres - radii) / self.step).astype(int), np.floor((centres + radii) / self.step).astype(int)
        lo, hi = np.maximum(lo, 0), np.minimum(hi, self.db.shape[1] - 1)
        bins = lo[:, None] + np.arange(max(int((hi - lo).max()) + 1, 1))
        held = bins <= hi[:, None]
        bins = np.minimum(bins, self.db.shape[1] - 1)
        held &= free[bins]
        own = np.arange(len(bins))
        at = bins[own, np.where(held, self.db[:, bins], -np.inf).argmax(axis=2)]
        ends = bins[own, held.argmax(axis=1)], bins[own, bins.shape[1] - 1 - held[:, ::-1].argmax(axis=1)]
        return self._told(at, (held.sum(axis=1) >= 3) & (at != ends[0]) & (at != ends[1]), inner=True)


@lru_cache(maxsize=4)
def _hanning(size: int) -> np.ndarray:
    return np.hanning(size)


def _spectra(frames: np.ndarray, size: int, fft: int, rate: float) -> Spectra:
    frames = frames - frames.mean(axis=1, keepdims=True)
    db = 20 * np.log10(np.abs(np.fft.rfft(frames * _hanning(size), n=fft)) + 1e-12)
    f = np.arange(db.shape[1]) * rate / fft
    top = min(TOP_HZ, rate / 2 - 1)
    inside = db[:, np.searchsorted(f, 50, "right") : np.searchsorted(f, top)]
    floor = np.median(inside, axis=1)
    return Spectra(rate / fft, db, floor, np.maximum(floor + OVER, inside.max(axis=1) - UNDER), rate / size, top)


def spectra(x: np.ndarray, rate: float) -> Spectra | None:
    """Overlapping frames of a chord's samples; none of less than 80 ms."""
    if len(x) < int(0.08 * rate):
        return None
    size = 8192 if len(x) >= 1.2 * 8192 else min(4096, len(x))
    starts = np.arange(0, len(x) - size + 1, max(1, size // 4))
    return _spectra(np.lib.stride_tricks.sliding_window_view(np.asarray(x, dtype=float), size)[starts], size, 1 << int(np.ceil(np.log2(size * 8))), rate)


def tone_cents(s: Spectra, midi: float, centre: float, reach: float, others: list[float], blanked: list[float] | None = None) -> float | None:
    """Cents of a tone off ``midi``, from those of its partials around ``centre`` that no other tone has.

    With ``blanked`` no partial is left out, but the places of those tones'
    partials are. At least two partials of a frame must agree.
    """
    f0 = float(hz(centre))
    ks = np.arange(1, PARTIALS + 1)
    ks = ks[ks * f0 < s.top]
    if blanked is None:
        for other in hz(others) if others else ():
            f = ks * f0
            ks = ks[np.abs(f - np.maximum(1, np.round(f / other)) * other) > f * _ratio(reach) + 1.5 * s.resolution]
    free = np.ones(s.db.shape[1], dtype=bool)
    for other in hz(blanked) if blanked else ():
        for f in other * np.arange(1, int(s.top / other) + 2):
            free[s.band(f, 1.5 * s.resolution + f * _ratio(BLANK))] = False
    if len(ks) < 2:
        return None
    found, weight = s.tops(ks * f0, np.maximum(ks * f0 * _ratio(reach), 1.5 * s.resolution), free)
    told = 69 + 12 * np.log2(found / ks / 440)
    several = (n := (~np.isnan(told)).sum(axis=1)) >= 2
    if not several.any():
        return None
    told, weight, n = told[several], weight[several], n[several]
    # What is no number comes last in order, so these two are the middle of the others.
    order, rows = np.sort(told, axis=1), np.arange(len(told))
    agree = np.abs(told - ((order[rows, (n - 1) // 2] + order[rows, n // 2]) / 2)[:, None]) <= AGREE
    w = np.where(agree, weight, 0.0)
    sure = agree.sum(axis=1) >= 2
    if not sure.any():
        return None
    mean = (w * np.where(agree, told, 0.0)).sum(axis=1)[sure] / w.sum(axis=1)[sure]
    return round((float(np.median(mean)) - midi) * 100, 1)


def hidden(tone: float, tones) -> bool:
    """Whether a lower tone of the chord has all of the tone's partials."""
    return any(tone - o in WITHIN for o in tones)


def chord_cents(x: np.ndarray, rate: float, tones: list[float], wanted: list[float] | None = None) -> dict[float, float | None]:
    """Cents of each written tone, or of the ``wanted`` ones: first from partials that no other can have, then from where all were found."""
    wanted = tones if wanted is None else wanted
    s = spectra(x, rate)
    if s is None:
        return dict.fromkeys(wanted)
    first = {m: tone_cents(s, m, m, SEARCH, [o for o in tones if o != m]) for m in tones}
    now = {m: m + (c or 0.0) / 100 for m, c in first.items()}
    out: dict[float, float | None] = {}
    for m in wanted:
        others = [o for o in tones if o != m]
        if hidden(m, tones):
            out[m] = None
            continue
        reach = UNKNOWN if first[m] is None else REFINE
        found = tone_cents(s, m, now[m], reach, [now[o] for o in others])
        if found is None and all(first[o] is not None for o in others):
            found = tone_cents(s, m, now[m], reach, [], [now[o] for o in others])
        out[m] = first[m] if found is None else found
    return out


def two_series(x: np.ndarray, rate: float, target: float, heard: float) -> dict | None:
    """Whether the written tone's partials sound, or the heard one's, or both, and the written tone's pitch if so.

    Each series is judged by the partials that the other, continued, doesn't
    have. ``check`` is confirmed, two-series, wrong-note or unclear; cents are
    off the written tone, null unless it sounds; margin is decibels over the other.
    """
    x = np.asarray(x, dtype=float)
    if len(x) < int(LEAST * rate) or not np.any(x - x.mean()):
        return None
    s = _spectra(x[None, :], len(x), 1 << int(np.ceil(np.log2(max(len(x) * 4, 8192)))), rate)
    reach = lambda f: max(f * _ratio(TOLERANCE), s.resolution)
    weights = np.array(WEIGHTS)

    def series(base: float, other: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(its own partials, where each peaks, levels, all of it by number)."""
        f = base * np.arange(1, len(weights) + 1)
        own = (f < 0.75 * other) | (np.abs(f - other * np.round(f / other)) > [reach(v) for v in f])
        bins = [s.band(v, reach(v)) for v in f]
        at = np.array([s.peaks(b)[0][0] if v < rate / 2 - 1 else np.nan for v, b in zip(f, bins)])
        level = np.array([s.db[0, b].max(initial=-240.0) for b in bins])
        return own, at, level, f

    written, played = float(hz(target)), float(hz(heard))
    mine, theirs = series(written, played), series(played, written)

    def share(one) -> float | None:
        own, at, *_ = one
        return round(float(weights[own & ~np.isnan(at)].sum() / weights[own].sum()), 2) if own.any() else None

    def loud(one) -> float | None:
        own, _, level, _ = one
        return float((weights * level)[own].sum() / weights[own].sum()) if own.any() else None

    a, b = share(mine), share(theirs)
    margin = round(loud(mine) - loud(theirs), 1) if a is not None and b is not None else None
    if a is not None and b is not None:
        here, there = a >= SERIES and margin >= RESIDUE, b >= SERIES
    elif a is None:  # the written tone is a partial of the heard one
        there = b is not None and b >= SERIES
        here = not there and not np.isnan(mine[1][0])
    else:  # the heard tone is a partial of the written one
        here = a >= SERIES
        there = not here and not np.isnan(theirs[1][0])
    check = {(True, False): "confirmed", (True, True): "two-series", (False, True): "wrong-note"}.get((bool(here), bool(there)), "unclear")
    cents = None
    if here:
        own, at, *_ = mine
        used = np.flatnonzero(own if own.any() else np.ones(len(at), bool))[:4]
        used = used[~np.isnan(at[used])]
        if len(used):
            cents = round((float(np.median(69 + 12 * np.log2(at[used] / (used + 1) / 440))) - target) * 100, 1)
    return {"check": check, "cents": cents, "target": a, "other": b, "margin": margin}


def chunks(takes: DataFrame, key: str, samples: str, rate: str, seconds: float = 1.0) -> DataFrame:
    """(key, rate, chunk, part): samples in runs of so many seconds, numbered from 0."""
    held = takes.where(F.size(samples) > 0).select(key, F.col(rate).alias("rate"), F.col(samples).alias("_s"))
    held = held.withColumns({"_size": F.greatest(F.lit(1), F.floor(F.col("rate") * seconds)).cast("int"), "_n": F.size("_s")})
    # Slices are taken after the explode: within a lambda each of them would go through the whole take.
    held = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / F.col("_size")).cast("int") - 1)))
    return held.select(key, "rate", "_size", "_n", "chunk", F.slice("_s", F.col("chunk") * F.col("_size") + 1, F.col("_size")).alias("part"))


def _asked(requests: DataFrame, pieces: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Requests with ``rate`` and the first and last sample of their seconds, as far as the take goes."""
    heads = pieces.groupBy(key).agg(F.first("rate").alias("rate"), F.first("_size").alias("_size"), F.first("_n").alias("_n"))
    first = F.least(F.greatest(F.lit(0), F.floor(F.col(lo) * F.col("rate"))), F.col("_n")).cast("long")
    last = F.least(F.greatest(first, F.floor(F.col(hi) * F.col("rate"))), F.col("_n")).cast("long")
    return requests.join(heads, key).withColumns({"_a": first, "_z": last})


def _met(asked: DataFrame, pieces: DataFrame, key: str, ident: str) -> DataFrame:
    """(chunk, part) of each request: what it asks of each chunk that it reaches into."""
    spread = asked.where("_z > _a").select(key, ident, "_a", "_z", "_size", F.explode(F.sequence(F.floor(F.col("_a") / F.col("_size")).cast("int"), F.floor((F.col("_z") - 1) / F.col("_size")).cast("int"))).alias("chunk"))
    at = F.col("chunk").cast("long") * F.col("_size")
    begin = F.greatest(F.lit(0), F.col("_a") - at)
    own = F.slice("part", (begin + 1).cast("int"), (F.least(F.col("_z") - at, F.col("_size").cast("long")) - begin).cast("int"))
    # Samples are never broadcast, however small Spark takes them to be.
    return spread.join(pieces.select(key, "chunk", "part").hint("merge"), [key, "chunk"]).select(key, ident, "chunk", own.alias("part"))


def clips(requests: DataFrame, pieces: DataFrame, key: str, ident: str, lo: str, hi: str) -> DataFrame:
    """Requests with ``rate`` and ``clip``: the samples of their seconds lo..hi, as far as the take has them; else none."""
    asked = _asked(requests, pieces, key, lo, hi)
    one = _met(asked, pieces, key, ident).groupBy(key, ident).agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("_p"))
    clip = F.flatten(F.transform("_p", lambda p: p["part"]))
    return asked.drop("_a", "_z", "_size", "_n").join(one.select(key, ident, clip.alias("clip")).hint("merge"), [key, ident], "left")


#: Samples of a row on its way to a kernel: Arrow batches are bounded by rows alone, so that 10 000 of them are 41 MB.
RUN = 512


#: Seconds of a take that one stream has, at least; and no take's length, for requests that go on to its end.
BLOCK, FOREVER = 60.0, 1e9


def _streams(requests: DataFrame, pieces: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """One table of requests (``_head``, chunk -1) and of runs of samples (``_x``), with the block of seconds in which they meet.

    A request is in the block in which it begins; a block's samples go on for as
    long as the longest request after its end. So no table of samples is ever a
    side of a join, where Spark might take it for small: of rows that Python makes
    longer, all it knows is how short they were before.
    """
    begin, end = F.greatest(F.lit(0.0), F.nanvl(F.col(lo).cast("double"), F.lit(0.0))), F.least(F.lit(FOREVER), F.nanvl(F.col(hi).cast("double"), F.lit(0.0)))
    asked = requests.where(F.col(key).isNotNull()).select(key, F.struct(*requests.columns).alias("_head"), begin.alias("_begin"), (end - begin).alias("_long")).where("_long > 0")
    longest = asked.select(F.max("_long")).scalar()
    seconds = F.greatest(F.lit(BLOCK), 4 * longest)
    heads = asked.select(key, F.floor(F.col("_begin") / seconds).alias("_block"), F.lit(-1).alias("chunk"), F.lit(0).alias("_run"), "_head")
    # A thousandth of a second more than a block's requests can ask for, as times are rounded.
    at, rate = F.col("chunk").cast("long") * F.col("_size"), F.col("rate").cast("double")
    first, last = F.floor((at / rate - longest - 0.001) / seconds), F.floor(((at + F.size("part") + 1) / rate + 0.001) / seconds)
    held = pieces.where(F.nanvl(rate, F.lit(0.0)) > 0).withColumns({"_first": F.greatest(F.lit(0).cast("long"), first), "_last": last})
    held = held.withColumn("_block", F.explode(F.sequence("_first", F.greatest("_first", "_last"))))
    short = held.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.size("part") - 1) / RUN).cast("int"))))
    short = short.select(key, "_block", "chunk", "_run", F.slice("part", F.col("_run") * RUN + 1, F.lit(RUN)).alias("_x"), "rate", "_size", "_n")
    return dealt(heads.unionByName(short, allowMissingColumns=True), [key, "_block"]).sortWithinPartitions(key, "_block", "chunk", "_run")


def read(requests: DataFrame, pieces: DataFrame, key: str, ident: str, lo: str, hi: str, kernel: Callable, columns: str) -> DataFrame:
    """(key, ident, columns): ``kernel(request, clip)`` of each request that has samples in lo..hi, as a tuple of the columns.

    Requests come to the kernels ahead of their block's samples, which follow as
    a stream of short runs: a task never holds more than a batch of runs, a
    block's requests and the clips that have begun. Samples are read and exchanged once.
    """
    ready(requests.sparkSession)
    rows = _streams(requests, pieces, key, lo, hi)
    spec = T.StructType([*(requests.schema[k] for k in (key, ident)), *T.StructType.fromDDL(columns).fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(spec)

        def place(second: float | None, rate: float, n: int) -> int:
            """The sample at a second, of a take of so many."""
            v = float(second) * rate if second is not None else 0.0
            return n if v >= n else int(v) if v > 0 else 0

        now, heads, asked = None, [], []  # block of a take, its requests, and (first, last, request, samples) of those not answered yet

        def answered() -> None:
            if asked:
                raise ValueError(f"samples of {now} end before its requests do")

        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            keys, block, chunk = batch.column(key), batch.column("_block").to_numpy(), batch.column("chunk").to_numpy()
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])) + 1
            for lo_row, hi_row in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if (here := (keys[lo_row].as_py(), int(block[lo_row]))) != now:
                    answered()
                    now, heads, asked = here, [], []
                at = lo_row + int((chunk[lo_row:hi_row] < 0).sum())
                heads += batch.column("_head").slice(lo_row, at - lo_row).to_pylist()
                if at == hi_row or not (heads or asked):
                    continue
                rate, size, n = (batch.column(c)[at].as_py() for c in ("rate", "_size", "_n"))
                for head in heads:
                    a = place(head[lo], rate, n)
                    if (z := place(head[hi], rate, n)) > a:
                        asked.append((a, z, head | {"rate": rate}, []))
                heads = []
                first = int(chunk[at]) * size + batch.column("_run")[at].as_py() * RUN
                # Samples that are no number are nulls to Spark's readers.
                x = batch.column("_x").slice(at, hi_row - at).flatten().to_numpy(zero_copy_only=False)
                going = []
                for a, z, head, held in asked:
                    if a < first + len(x):
                        held.append(np.array(x[max(a - first, 0) : z - first]))
                    if z <= first + len(x):
                        out.append((head[key], head[ident], *kernel(head, np.concatenate(held).astype(float))))
                    else:
                        going.append((a, z, head, held))
                asked = going
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type, from_pandas=True) for c, f in zip(zip(*out), target)], schema=target)
        answered()

    return rows.mapInArrow(run, spec)


def longest_run(wanted: DataFrame, activity: DataFrame, key: str) -> DataFrame:
    """(key, id, midi, run_lo, run_hi): of each wanted key (id, midi, lo, hi) the longest run of activity (midi, start, stop) within lo..hi."""
    a = activity.select(key, "midi", "start", "stop")
    met = wanted.select(key, "id", "midi", "lo", "hi").join(a, [key, "midi"]).where((F.col("start") < F.col("hi")) & (F.col("stop") > F.col("lo")))
    run = F.struct((F.least("stop", "hi") - F.greatest("start", "lo")).alias("long"), (-F.greatest("start", "lo")).alias("early"), F.least("stop", "hi").alias("hi"))
    return met.groupBy(key, "id", "midi").agg(F.max(run).alias("_r")).select(key, "id", "midi", (-F.col("_r.early")).alias("run_lo"), F.col("_r.hi").alias("run_hi"))


def chord_tones(takes: DataFrame, chords: DataFrame, activity: DataFrame, key: str, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """(key, id, midi, state, cents) of each tone of chords (id, tones, onset, stop).

    ``activity`` (midi, start, stop) says when each key sounds. A tone that
    doesn't, for 0.1 s, is ``missing``, or ``unchecked`` where the take's edge
    may have cut it; one whose partials a lower tone has is ``inseparable``; others
    are ``measured``, each over its own longest run, or ``unmeasured``.
    """
    ready(takes.sparkSession)
    ends = takes.select(key, (F.size(samples) / F.col(rate)).alias("_end"))
    tones = chords.select(key, "id", "tones", "onset", "stop", F.explode(F.array_distinct("tones")).alias("midi"))
    tones = tones.withColumns({"lo": F.greatest(F.lit(0.0), F.col("onset") - ROLL), "hi": F.col("stop")})
    told = tones.join(longest_run(tones, activity, key), [key, "id", "midi"], "left")
    long = F.col("run_hi") - F.col("run_lo")
    under = F.exists("tones", lambda o: F.array_contains(F.array(*map(F.lit, WITHIN)), (F.col("midi") - o).cast("int")))
    cut = (F.col("onset") - ROLL < EDGE) | (F.col("stop") > F.col("_end") - EDGE)
    told = told.withColumn("state", F.when(F.coalesce(long, F.lit(0.0)) < SOUNDS, "missing").when(under, "inseparable"))
    told = told.withColumn("ask", F.concat_ws(":", F.col("id").cast("string"), F.col("midi").cast("string")))
    asked = told.where("state IS NULL").select(key, "id", "midi", "tones", "ask", (F.col("run_lo") + F.greatest(F.lit(0.05), 0.25 * long)).alias("a"), (F.col("run_hi") - 0.15 * long).alias("z"))
    # Tones of a chord that sound together have one clip, and its spectra.
    asked = asked.groupBy(key, "id", "tones", "a", "z").agg(F.min("ask").alias("first"), F.collect_list(F.struct("ask", "midi")).alias("wanted"))

    def kernel(r, clip: np.ndarray) -> tuple:
        got = chord_cents(clip, r["rate"], sorted({float(t) for t in r["tones"]}), [float(w["midi"]) for w in r["wanted"]])
        return ([{"ask": w["ask"], "cents": got[float(w["midi"])]} for w in r["wanted"]],)

    found = read(asked, chunks(takes, key, samples, rate), key, "first", "a", "z", kernel, "told array<struct<ask: string, cents: double>>").select(key, F.inline("told"))
    both = told.join(ends, key, "left").join(found, [key, "ask"], "left").withColumn("state", F.when((F.col("state") == "missing") & cut, "unchecked").otherwise(F.col("state")))
    cents = F.when(~F.isnan("cents"), F.col("cents"))
    return both.select(key, "id", "midi", F.coalesce("state", F.when(cents.isNotNull(), "measured").otherwise("unmeasured")).alias("state"), cents.alias("cents"))


def verified(takes: DataFrame, notes: DataFrame, key: str, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """Notes (id, midi, cents, lo, hi) with ``check``, ``margin``, ``raw`` and, where the written tone sounds, its own cents.

    Only readings more than 150 cents off are checked; others stay as they are.
    """
    ready(takes.sparkSession)
    doubt = notes.where(F.abs("cents") > DOUBT)

    def kernel(r, clip: np.ndarray) -> tuple:
        midi = np.nan if r["midi"] is None else float(r["midi"])
        got = two_series(clip, r["rate"], midi, midi + r["cents"] / 100) or {}
        return got.get("check"), got.get("margin"), got.get("cents")

    found = read(doubt.select(key, "id", "midi", "cents", "lo", "hi"), chunks(takes, key, samples, rate), key, "id", "lo", "hi", kernel, "check string, margin double, found double")
    both = notes.join(found, [key, "id"], "left")
    return both.withColumns({"raw": F.when(F.col("found").isNotNull(), F.col("cents")), "cents": F.coalesce("found", "cents")}).drop("found")


def reread(takes: DataFrame, notes: DataFrame, activity: DataFrame, key: str, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """Notes (id, midi, cents, lo, hi) with ``raw`` and new cents where a sensor clearly hears the written key.

    ``activity`` (midi, start, stop, strength): the written key's mean strength
    over the note must reach 0.3 and be the largest of all keys; its own partials
    then give the cents, unless these are more than 100 off. Readings within 150
    cents, and null ones, stay.
    """
    ready(takes.sparkSession)
    doubt = notes.where(F.abs("cents") > DOUBT).select(key, "id", F.round("midi").cast("int").alias("written"), "lo", F.greatest("hi", F.col("lo") + 0.05).alias("hi"))
    share = F.greatest(F.lit(0.0), F.least("stop", "hi") - F.greatest("start", "lo")) * F.col("strength") / (F.col("hi") - F.col("lo"))
    heard = doubt.join(activity, key).where((F.col("start") < F.col("hi")) & (F.col("stop") > F.col("lo"))).groupBy(key, "id", "written", "lo", "hi", "midi").agg(F.sum(share).alias("mean"))
    top = heard.withColumn("most", F.max("mean").over(Window.partitionBy(key, "id"))).where((F.col("midi") == F.col("written")) & (F.col("mean") >= STRENGTH) & (F.col("mean") >= F.col("most")))
    runs = longest_run(top.select(key, "id", "midi", (F.col("lo") - 0.05).alias("lo"), "hi"), activity.where(F.col("strength") >= STRENGTH), key)
    long = F.col("run_hi") - F.col("run_lo")

    def kernel(r, clip: np.ndarray) -> tuple:
        s = spectra(clip, r["rate"])
        return (tone_cents(s, r["midi"], r["midi"], SEARCH, []) if s is not None else None,)

    asked = runs.select(key, "id", "midi", (F.col("run_lo") + 0.15 * long).alias("a"), (F.col("run_hi") - 0.1 * long).alias("z"))
    found = read(asked, chunks(takes, key, samples, rate), key, "id", "a", "z", kernel, "found double").where(~F.isnan("found") & (F.abs("found") <= FAR))
    both = notes.join(found, [key, "id"], "left")
    return both.withColumns({"raw": F.when(F.col("found").isNotNull(), F.col("cents")), "cents": F.coalesce("found", "cents")}).drop("found")
