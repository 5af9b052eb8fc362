"""Scalar expressions: pitch, deviation classes, weights, scores, labels.

All are column expressions. Null is "no evidence" and stays null unless a
function says otherwise; it never turns into zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deviation in cents up to which a note is in tune, by default.
TOLERANCE = 25.0
#: Timing limits in milliseconds, and grades by deviation in cents.
LATE_MS = 80.0
GRADES = [(25.0, "green"), (50.0, "orange"), (100.0, "purple")]
#: Names of the twelve pitch classes.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def half_even(x: Column) -> Column:
    """Round to a whole number, ties to even."""
    return F.rint(x)


def half_up(x: Column) -> Column:
    """Round to a whole number, ties towards positive infinity."""
    return F.floor(x + 0.5).cast("double")


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def hz_to_midi(hz: Column) -> Column:
    return F.when(hz > 0, 69 + 12 * F.log2(hz / 440.0))


def midi_to_hz(midi: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (midi - 69.0) / 12.0)


def cents(heard: Column, target: Column) -> Column:
    """Deviation in cents, one decimal."""
    return F.round((heard - target) * 100.0, 1)


def classify_deviation(deviation: Column, tolerance: float | Column = TOLERANCE) -> Column:
    """correct, sharp, flat, octave, outlier or uncertain, decided in this order:

    no evidence; an octave (1 200 within 80); beyond an octave; within the
    tolerance, which is inclusive; else its sign.
    """
    size = F.abs(deviation)
    return (
        F.when(deviation.isNull() | F.isnan(deviation), "uncertain")
        .when(F.abs(size - 1200) <= 80, "octave")
        .when(size > 1200, "outlier")
        .when(size <= tolerance, "correct")
        .when(deviation > 0, "sharp")
        .otherwise("flat")
    )


def classify_timing(error_ms: Column, limit: float | Column = LATE_MS) -> Column:
    return F.when(error_ms.isNull(), "uncertain").when(error_ms > limit, "late").when(error_ms < -F.lit(limit) if not isinstance(limit, Column) else error_ms < -limit, "early").otherwise("correct")


def timing_limit(seconds_per_beat: Column) -> Column:
    """A limit that follows the tempo: 150 ms a second of beat, within 50 to 120."""
    return F.least(F.lit(120.0), F.greatest(F.lit(50.0), 150.0 * seconds_per_beat))


def merge_status(pitch: Column, timing: Column) -> Column:
    """One status of two: a wrong pitch outranks timing."""
    return (
        F.when(pitch.isin("sharp", "flat"), "wrong_pitch")
        .when(pitch == "octave", "octave_uncertain")
        .when(pitch.isin("outlier", "uncertain"), pitch)
        .when(timing.isin("late", "early"), timing)
        .when(timing == "uncertain", "timing_uncertain")
        .otherwise("correct")
    )


def deviation_weight(deviation: Column, wrong: Column | None = None) -> Column:
    """How much a deviation counts: 1 to 150 cents, then falling, .3 at least, 0 beyond 600.

    A note known to be wrong counts in full. No evidence weighs 0.
    """
    size = F.abs(deviation)
    out = F.when(deviation.isNull(), 0.0).when(size <= 150, 1.0).when(size > 600, 0.0).otherwise(F.greatest(F.lit(0.3), 1.0 - (size - 150.0) / 450.0))
    return out if wrong is None else F.when(wrong, 1.0).otherwise(out)


def rhythm_score(spread_ms: Column, offset_ms: Column) -> Column:
    """0 to 100 from the spread and the common offset, with dead zones of 15 and 30 ms."""
    lost = F.greatest(F.lit(0.0), spread_ms - 15.0) * 0.5 + F.greatest(F.lit(0.0), F.abs(offset_ms) - 30.0) * 0.15
    return F.when(spread_ms.isNotNull() & offset_ms.isNotNull(), half_even(F.greatest(F.lit(0.0), 100.0 - lost)))


def strict_rhythm_score(spread_ms: Column, offset_ms: Column) -> Column:
    """The same without dead zones, for gates."""
    return F.when(spread_ms.isNotNull() & offset_ms.isNotNull(), half_even(F.greatest(F.lit(0.0), 100.0 - spread_ms * 0.5 - F.abs(offset_ms) * 0.15)))


def pulse_quarters(beats: Column, unit: Column) -> Column:
    """Quarters of a pulse: compound meters (6, 9 or 12 over 8) pulse in dotted quarters."""
    return F.when((unit == 8) & beats.isin(6, 9, 12), 1.5).otherwise(4.0 / unit)


def seconds_per_quarter(bpm: Column, beats: Column, unit: Column) -> Column:
    return F.when(bpm > 0, 60.0 / bpm / pulse_quarters(beats, unit))


def note_name(midi: Column) -> Column:
    names = F.array(*(F.lit(n) for n in NOTE_NAMES))
    return F.concat(F.get(names, F.pmod(midi.cast("int"), F.lit(12))), (F.floor(midi / 12) - 1).cast("string"))


def verdict(p: Column) -> Column:
    """heard from .7 on, absent up to .3, unclear between, unchecked without evidence."""
    return F.when(p.isNull(), "unchecked").when(p >= 0.7, "heard").when(p <= 0.3, "absent").otherwise("unclear")


def masked(p: Column, hidden: Column) -> Column:
    """Evidence that something else may explain is halved towards .5."""
    return F.when(hidden, 0.5 + (p - 0.5) * 0.5).otherwise(p)


def grade(deviation: Column) -> Column:
    out = F.when(deviation.isNull(), "none")
    for limit, name in GRADES:
        out = out.when(F.abs(deviation) <= limit, name)
    return out.otherwise("red")


def badness(grade_: Column) -> Column:
    return F.when(grade_ == "orange", 1).when(grade_ == "purple", 2).when(grade_ == "red", 3).otherwise(0)


def key_of_name(name: Column) -> Column:
    """Key of a title: no extension, single spaces, lower case, 200 characters."""
    bare = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    return F.substring(F.lower(F.trim(F.regexp_replace(bare, r"\s+", " "))), 1, 200)


def email_of(raw: Column) -> Column:
    """Normalised address, or null where it isn't one."""
    tidy = F.lower(F.trim(raw))
    return F.when(tidy.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & (F.length(tidy) <= 254), tidy)


def utc_day(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd")


def content_key(*parts: Column) -> Column:
    """SHA-256 of the parts as one JSON array: the same content has the same key."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)))), 256)


def djb2(text: Column) -> Column:
    """Multiply-by-33 hash of the UTF-16-free code points, 32 bits, unsigned."""
    return F.aggregate(F.split(text, ""), F.lit(5381).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h * 33 + F.ascii(c)) % F.lit(1 << 32)))


def degradation(has_pitch: Column, has_onset: Column, has_beat: Column, beat_rejected: Column) -> Column:
    """Which sensors were replaced, in a fixed order."""
    return F.array_compact(F.array(F.when(~has_pitch, F.lit("pitch:builtin")), F.when(~has_onset, F.lit("onset:builtin")), F.when(beat_rejected, F.lit("beat:rejected")).when(~has_beat, F.lit("beat:legacy"))))


def transpose(midi: Column, semitones: int, octave_only: bool = False) -> Column:
    return midi + (12 * round(semitones / 12) if octave_only else semitones)


def beat_at(seconds: Column, start: Column, seconds_per_beat: Column, beats_per_measure: Column) -> Column:
    """struct(index, measure, beat) of the score clock at a time; measures and beats from 1."""
    index = F.floor((seconds - start) / seconds_per_beat).cast("long")
    return F.struct(index.alias("index"), (F.floor(index / beats_per_measure) + 1).cast("long").alias("measure"), (F.pmod(index, beats_per_measure) + 1).cast("long").alias("beat"))


def within_request(bpm: Column, tolerance: Column, start_measure: Column) -> Column:
    """Reasons for which a request is refused; empty if none."""
    return F.array_compact(F.array(
        F.when(bpm.isNull() | ~bpm.between(15, 360), F.lit("bpm")), F.when(tolerance.isNull() | ~tolerance.between(1, 100), F.lit("tolerance")),
        F.when(start_measure.isNull() | (start_measure < 0), F.lit("start_measure")),
    ))


def retryable(status: Column) -> Column:
    """Whether a failure may pass by itself: no answer, too many requests, or the server's own."""
    return F.when(status.isNull(), True).otherwise(status.isin(408, 425, 429) | (status >= 500))


def finite_score(x: Column) -> Column:
    """A score from 0 to 100, else null."""
    return F.when(x.isNotNull() & ~F.isnan(x) & x.between(0, 100), x)


def parse_ranges(text: Column) -> Column:
    """"3-5, 9" -> array of (lo, hi); parts that are no range are skipped."""
    parts = F.split(text, ",")
    lo = lambda p: F.regexp_extract(p, r"^\s*(\d+)", 1)
    hi = lambda p: F.regexp_extract(p, r"-\s*(\d+)\s*$", 1)
    made = F.transform(parts, lambda p: F.when(p.rlike(r"^\s*\d+\s*(-\s*\d+\s*)?$"), F.struct(lo(p).cast("int").alias("lo"), F.when(hi(p) == "", lo(p)).otherwise(hi(p)).cast("int").alias("hi"))))
    return F.filter(made, lambda r: r.isNotNull() & (r["lo"] <= r["hi"]))


def parse_meters(text: Column) -> Column:
    """"1:4, 9:3" -> map of measure to beats."""
    good = F.filter(F.split(text, ","), lambda p: p.rlike(r"^\s*\d+\s*:\s*\d+\s*$"))
    return F.map_from_entries(F.transform(good, lambda p: F.struct(F.trim(F.split(p, ":")[0]).cast("int"), F.trim(F.split(p, ":")[1]).cast("int"))))


def video_id(url: Column) -> Column:
    """The id of a video address in its common forms, or null."""
    found = F.regexp_extract(url, r"(?:v=|youtu\.be/|/embed/|/shorts/|/live/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.when(found != "", found)


def scored_pitch(deviation: Column, midi: Column, pitch_status: Column, status: Column) -> Column:
    """Whether a note's pitch counts: heard, in range (MIDI 36 to 96), no octave and no outlier, and not set aside by its status."""
    size = F.abs(deviation)
    plausible = deviation.isNotNull() & ~F.isnan(deviation) & (size <= 1200) & (F.abs(size - 1200) > 80)
    in_range = midi.isNull() | (midi + deviation / 100.0).between(36, 96)
    kept = F.when(pitch_status.isNotNull(), pitch_status.isin("correct", "sharp", "flat")).otherwise(F.coalesce(~status.isin("uncertain", "octave_uncertain", "outlier", "missed", "excluded"), F.lit(True)))
    return F.coalesce(plausible & in_range & kept, F.lit(False))


def common_divisions(lengths: Column) -> Column:
    """Least number of divisions of a quarter that makes lengths (structs num, den) whole: the lcm of their denominators."""
    gcd = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))), lambda s: s["a"])
    return F.aggregate(F.transform(lengths, lambda x: x["den"].cast("long")), F.lit(1).cast("long"), lambda m, d: (m / gcd(m, d)).cast("long") * d)
