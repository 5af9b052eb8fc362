"""Data-quality rules, verdicts and guards.

Rules are boolean columns with names; a row carries the names of those that
hold. Verdicts read one row of evidence and refuse (null and a reason) rather
than give a score of zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import parts

from . import windows as W

#: How much each structural symptom lets a measure be doubted.
SYMPTOM_DOUBT = {"staff_mismatch": 0.85, "voice_overfull": 0.80, "voice_short": 0.75, "voice_short_secondary": 0.75, "voice_echo": 0.70, "beam_open": 0.40, "type_duration": 0.0}
#: Outcomes of a verdict.
OUTCOMES = ["complete", "complete_with_rescue", "partial", "insufficient_evidence", "score_audio_mismatch", "score_unreliable"]


def named(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their order; a rule that is null doesn't."""
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def symptoms(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``symptoms`` and ``doubt``, the largest of theirs."""
    doubt = F.greatest(F.lit(0.0), *(F.when(F.coalesce(rule, F.lit(False)), SYMPTOM_DOUBT[name]).otherwise(0.0) for name, rule in rules.items()))
    return df.withColumns({"symptoms": named(rules), "doubt": doubt})


def guard(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``faults``: the constraints that a row breaks."""
    return df.withColumn("faults", named(rules))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows without faults, rows with them and their names)."""
    held = guard(df, rules)
    return held.where(F.size("faults") == 0).drop("faults"), held.where(F.size("faults") > 0)


def sequence_verdict(s: DataFrame) -> DataFrame:
    """Outcome and issues of a group from (n, scored, agreement, kinds)."""
    share = F.col("scored") / F.col("n")
    outcome = F.when(F.col("n") < 50, "insufficient_evidence").when(share < 0.3, "score_unreliable").when(F.col("agreement") < 0.35, "score_audio_mismatch").when(F.col("kinds") < 5, "partial").otherwise("complete")
    issues = named({"low_coverage": share < 0.6, "score_audio_mismatch": F.col("agreement") < 0.35, "beat_grid_rejected": F.col("kinds") < 5})
    return s.select("user_id", outcome.alias("outcome"), F.array_join(issues, ",").alias("issues"))


#: Limits of the verdict.
HALF, COVERED, ASTRAY, MISMATCH, LEAST_SCORED, RHYTHM_FLOOR, HEARD_FLOOR, PITCH_FLOOR = 0.5, 0.6, 0.2, 0.4, 12, 60, 0.6, 0.5


def verdict(results: DataFrame) -> DataFrame:
    """Verdict of result rows: adds issues, outcome, overall, reliability, match_rate, pitch_coverage, timing_coverage, unheard.

    Reads the counts notes, scored, correct (null if unknown), voiced,
    timing_candidates, timed, outliers, octaves, excluded; the scores pitch
    and rhythm (null without one); reasons (array of replaced sensors) and the
    booleans unaligned, degraded, clipped, unsure, tempo_mismatch, refused,
    beyond_score, rescued, range_rescue. A null boolean or count is none, but
    for older results: without ``scored`` the voiced notes are covered (though no
    match rate follows), without ``timing_candidates`` all notes but one are.
    With a boolean ``timeline`` (of ``timelines``) there is ``follow_ready``: the
    timeline is valid, and nothing says that it is another score's.

    A mismatch of score and take needs an unverified timeline: many wrong notes
    on a verified one are a poor performance, and stay scored. The overall
    score needs both scores on a verified, covered timeline; it is never made
    up from one.
    """
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    count = lambda n: F.coalesce(F.col(n), F.lit(0))
    share = lambda part, whole: F.when(whole > 0, F.least(F.lit(1.0), part / whole)).otherwise(0.0)
    r = results.withColumns({
        "_pitch_coverage": share(F.coalesce("scored", count("voiced")), count("notes")), "_timing_coverage": share(count("timed"), F.coalesce("timing_candidates", F.greatest(F.lit(0), count("notes") - 1))), "_heard": share(count("voiced"), count("notes")),
        "_rejected": F.coalesce(F.array_contains("reasons", "beat:rejected"), F.lit(False)), "_only": F.coalesce(F.forall("reasons", lambda x: x == "beat:rejected"), F.lit(False)),
        "match_rate": F.when(F.col("correct").isNotNull() & (count("scored") >= LEAST_SCORED), F.round(F.col("correct") / F.col("scored"), 3)),
    })
    thin = flag("unsure") | (F.col("_pitch_coverage") < COVERED)
    slack = flag("tempo_mismatch") & F.coalesce(F.col("rhythm") < RHYTHM_FLOOR, F.lit(False))
    astray = (count("voiced") > 0) & ((count("outliers") + count("octaves") + count("excluded")) / F.greatest(count("voiced"), F.lit(1)) >= ASTRAY)
    unverified = flag("unaligned") | F.col("pitch").isNull() | thin
    r = r.withColumns({"_thin": thin, "_slack": slack, "_astray": astray, "_mismatch": F.coalesce(F.col("match_rate") < MISMATCH, F.lit(False)) & unverified & ~flag("rescued")})
    c = F.col
    issues = {
        "alignment_unverified": flag("unaligned"), "builtin_detectors": flag("degraded") & ~(c("_rejected") & c("_only")), "beat_grid_rejected": c("_rejected"), "clipped_audio": flag("clipped"),
        "low_coverage": c("_thin"), "tempo_mismatch": flag("tempo_mismatch"), "tempo_timing_unreliable": c("_slack"), "score_unreliable": flag("refused"), "take_beyond_score": flag("beyond_score"),
        "pitch_tracking_unreliable": c("_astray"), "score_audio_mismatch": c("_mismatch"),
    }
    scores = c("pitch").isNotNull().cast("int") + c("rhythm").isNotNull().cast("int")
    weak = flag("unaligned") | c("_thin") | c("_astray") | c("_slack") | flag("range_rescue")
    outcome = (
        F.when((scores == 0) & flag("refused"), "score_unreliable").when(scores == 0, "insufficient_evidence").when(c("_mismatch"), "score_audio_mismatch")
        .when((scores < 2) | weak, "partial").when(flag("rescued"), "complete_with_rescue").otherwise("complete")
    )
    borderline = (c("_heard") >= HEARD_FLOOR) & (c("_pitch_coverage") >= PITCH_FLOOR) & ~c("_mismatch")
    whole = (scores == 2) & ~flag("unaligned") & (~c("_thin") | borderline) & ~c("_astray") & ~c("_slack")
    if "timeline" in results.columns:
        r = r.withColumn("follow_ready", flag("timeline") & ~flag("unsure") & ~flag("unaligned") & ~c("_mismatch"))
    return r.withColumns({
        "issues": named(issues), "outcome": outcome, "overall": F.when(whole, F.floor(c("pitch") * HALF + c("rhythm") * HALF + 0.5).cast("double")), "reliability": F.when(whole, F.when(c("_thin"), "reference").otherwise("full")),
        "pitch_coverage": F.round("_pitch_coverage", 3), "timing_coverage": F.round("_timing_coverage", 3), "unheard": F.round(1 - c("_heard"), 3),
    }).drop("_pitch_coverage", "_timing_coverage", "_heard", "_rejected", "_only", "_thin", "_slack", "_astray", "_mismatch")


def fullness(notes: DataFrame, keys: list[str], duration: str, nominal: str, edge: Column) -> DataFrame:
    """voice_overfull, voice_short or none of each (measure, staff, voice); the score's edges may be short."""
    held = notes.groupBy(*keys).agg(F.sum(duration).alias("held"), F.max(nominal).alias("nominal"), F.bool_or(edge).alias("edge"))
    kind = F.when(F.col("held") > F.col("nominal") + 1e-6, "voice_overfull").when(~F.col("edge") & (F.col("held") < F.col("nominal") - 1e-6), "voice_short")
    return held.withColumn("symptom", kind)


def staff_mismatch(staffs: DataFrame, keys: list[str], held: str) -> DataFrame:
    return staffs.groupBy(*keys).agg((F.max(held) - F.min(held)).alias("difference")).where("difference > 1e-6")


def type_duration(kind: Column, dots: Column, actual: Column, normal: Column) -> Column:
    """Quarters that a note's printed type stands for."""
    base = F.create_map(*(F.lit(v) for pair in {"breve": 8.0, "whole": 4.0, "half": 2.0, "quarter": 1.0, "eighth": 0.5, "16th": 0.25, "32nd": 0.125, "64th": 0.0625}.items() for v in pair))[kind]
    return base * (2.0 - F.pow(F.lit(0.5), F.coalesce(dots, F.lit(0)))) * F.coalesce(normal, F.lit(1)) / F.coalesce(actual, F.lit(1))


def open_beams(notes: DataFrame, keys: list[str], beam: str) -> DataFrame:
    change = F.when(F.col(beam) == "begin", 1).when(F.col(beam) == "end", -1).otherwise(0)
    return notes.groupBy(*keys).agg(F.sum(change).alias("open")).where("open <> 0")


def echoes(notes: DataFrame, keys: list[str], key: str, voice: str, onset: str, within: float = 1.0) -> DataFrame:
    """Measures in which one key sounds in two voices within a beat: of the notes of a key in that reach, the voices differ."""
    at = F.round(F.col(onset) * 1000).cast("long")
    near = Window.partitionBy(*keys, key).orderBy(at).rangeBetween(-(round(within * 1000) - 1), 0)
    held = notes.withColumns({"_lo": F.min(voice).over(near), "_hi": F.max(voice).over(near)})
    return held.where(F.col("_lo") != F.col("_hi")).select(*keys).distinct()


def odd_measures(measures: DataFrame, keys: list[str], seq: str, held: str, nominal: str, implicit: Column) -> DataFrame:
    """Measures whose content isn't as long as their time signature says; a pickup or a short last one may be, and so may one marked as implicit."""
    w = Window.partitionBy(*keys)
    m = measures.withColumns({"_lo": F.min(seq).over(w), "_hi": F.max(seq).over(w)})
    edge = F.col(seq).isin(F.col("_lo"), F.col("_hi")) & (F.col(held) < F.col(nominal))
    odd = (F.col(nominal) > 0) & (F.col(held) > 0) & (F.abs(F.col(held) - F.col(nominal)) > 1e-3) & ~edge & ~implicit
    return m.where(odd).select(*keys, seq, F.round(held, 3).alias("held"), F.round(nominal, 3).alias("expected"))


def short_voices(events: DataFrame, measure: list[str], voice: list[str], at: str, length: str, rest: str, nominal: Column) -> DataFrame:
    """Voices that end before an otherwise full measure does, are no rests alone, and are one unbroken run of events."""
    whole = Window.partitionBy(*measure)
    w = Window.partitionBy(*measure, *voice).orderBy(at)
    # Packed events are a few bytes each, unpacked and sorted some hundred: parts that Spark joins by packed bytes would take GBs.
    e = events.repartition(parts(events.sparkSession), *measure).withColumns({"_end": F.col(at) + F.col(length), "_nominal": nominal})
    e = e.withColumns({"_top": F.max("_end").over(whole), "_joined": F.coalesce(F.col(at) == F.lag("_end").over(w), F.lit(True))})
    held = e.groupBy(*measure, *voice).agg(F.max("_end").alias("stop"), F.max("_top").alias("top"), F.max("_nominal").alias("nominal"), F.bool_and("_joined").alias("joined"), F.bool_and(rest).alias("silent"))
    return held.where((F.col("top") == F.col("nominal")) & (F.col("stop") < F.col("nominal")) & F.col("joined") & ~F.col("silent")).select(*measure, *voice, "stop", "nominal")


#: Of a measure's doubt, what stays when a second reading agrees; and doubt when it sides with the take.
CONFIRMED_SHARE, CONTRADICTED_DOUBT = 0.2, 0.7


def note_doubt(doubt: Column, kind: Column, read: Column, written: tuple[Column, Column], played: tuple[Column, Column]) -> Column:
    """struct(doubt, reason) about the score for one disagreement: ``missed`` (a written key wasn't
    played), ``wrong`` (another was) or ``extra``. ``written`` and ``played`` are how often the first and
    the second reading of the measure have that key; ``read`` says whether there is a second one."""
    more = played[1] > played[0]
    confirmed = (kind.isin("missed", "wrong") & (written[1] >= written[0])) | ((kind == "extra") & ~more)
    contradicted = (kind == "missed") | (kind.isin("wrong", "extra") & more)
    reason = F.when(~read, None).when(confirmed, "confirmed").when(contradicted, "contradicted")
    size = F.when(~read, doubt).when(confirmed, doubt * CONFIRMED_SHARE).when(contradicted, F.greatest(doubt, F.lit(CONTRADICTED_DOUBT))).otherwise(doubt)
    return F.struct(size.alias("doubt"), reason.alias("reason"))


def doubtful(notes: DataFrame, doubt: str, most: float = 0.5) -> DataFrame:
    """Adds ``scored`` (false from ``most`` doubt on) and ``trust``, the weight of what is left."""
    d = F.coalesce(F.col(doubt), F.lit(0.0))
    return notes.withColumns({"scored": d < most, "trust": F.when(d < most, 1.0 - d).otherwise(0.0)})


def valid_timeline(intervals: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Whether intervals in sequence are ordered and don't overlap; labels may repeat."""
    before = F.lag("stop").over(Window.partitionBy(*keys).orderBy(seq))
    ok = (F.col("stop") > F.col("start")) & (F.col("start") >= 0) & (before.isNull() | (F.col("start") >= before - 1e-6))
    return intervals.withColumn("_ok", ok).groupBy(*keys).agg(F.bool_and("_ok").alias("valid"))


def valid_markers(markers: DataFrame, keys: list[str], measure: str, time: str, duration: float) -> DataFrame:
    """Whether sync markers are of consecutive measures, increasing, and within the recording."""
    w = Window.partitionBy(*keys).orderBy(measure)
    step, before = F.col(measure) - F.lag(measure).over(w), F.lag(time).over(w)
    ok = (step.isNull() | (step == 1)) & (before.isNull() | (F.col(time) > before)) & F.col(time).between(0, duration)
    return markers.withColumn("_ok", ok).groupBy(*keys).agg(F.bool_and("_ok").alias("valid"), F.count("*").alias("markers"))


def systematic(errors: DataFrame, keys: list[str], kind: list[str], written: str, least: float = 0.7) -> DataFrame:
    """Kinds of error (pitch class, difference) that most written occurrences share."""
    held = errors.groupBy(*keys, *kind).agg(F.count("*").alias("n"), F.max(written).alias("written"))
    return held.where(F.col("n") / F.col("written") >= least).select(*keys, *kind, "n")


#: Occurrences of one conflict between score and take, measures between them, and measures that they must fill.
REPEATED, NEAR, SPREAD = 4, 4, 2


def repeated(items: DataFrame, keys: list[str], measure: str, *, gap: int = NEAR, least: int = REPEATED) -> DataFrame:
    """Items of runs whose neighbours are at most ``gap`` measures apart, of ``least`` items in two measures or more; with first, last and n of the run."""
    w = Window.partitionBy(*keys, "_run")
    held = W.runs(items.where(F.col(measure).isNotNull()), keys, measure, gap).withColumnRenamed("run", "_run")
    held = held.withColumns({"first": F.min(measure).over(w), "last": F.max(measure).over(w), "n": F.count("*").over(w)})
    return held.where((F.col("n") >= least) & (F.col("first") < F.col("last"))).drop("_run")


def systematic_runs(wrong: DataFrame, notes: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """Conflicts that the score must have made: (pitch_class, apart, first, last, n, written).

    ``wrong`` has (id, midi, measure, played) of written notes that sounded as
    another key; those of one pitch class and distance are a run if they are
    dense, and at least a share of all ``notes`` (midi, measure) written with the
    run's own keys between its ends: who misreads slips now and then, a score
    that lost an accidental is wrong each time.
    """
    e = wrong.select(*keys, "id", "midi", "measure", F.pmod(F.col("midi"), F.lit(12)).alias("pitch_class"), (F.col("played") - F.col("midi")).alias("apart"))
    kind = [*keys, "pitch_class", "apart"]
    runs = repeated(e, kind, "measure", gap=2 * NEAR)
    octaves = runs.select(*kind, "first", "last", "n", "midi").distinct()
    written = octaves.join(notes.select(*keys, "midi", F.col("measure").alias("_m")), [*keys, "midi"]).where(F.col("_m").between(F.col("first"), F.col("last")))
    held = written.groupBy(*kind, "first", "last", "n").agg(F.count("*").alias("written"))
    return held.where(F.col("n") >= share * F.col("written"))


def octave_shifts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(apart, first, last, n, note, heard) of missed notes and extras (measure, apart) an octave or two away, where it happens again and again."""
    return repeated(pairs.select(*keys, "note", "heard", "measure", "apart"), [*keys, "apart"], "measure")


def added_tones(extras: DataFrame, chords: DataFrame, measures: DataFrame, keys: list[str], within: float = 0.05) -> DataFrame:
    """(id, midi, measure, first, last, n): extras (id, midi, t) that are added to written chords (t) again and again: the score lost a tone.

    ``measures`` has (measure, start, stop); what lies in none is left out.
    """
    from .matching import containing, nearest

    near = nearest(extras.select(*keys, "id", "midi", "t"), chords.select(*keys, F.col("t").alias("_c")).distinct(), keys, "t", "_c", "_c", within)
    placed = containing(near.where(F.col("_c").isNotNull()).drop("_c"), measures.select(*keys, "start", "stop", "measure"), keys, "t", "measure")
    return repeated(placed, [*keys, "midi"], "measure").drop("t")


def voice_duplicates(notes: DataFrame, keys: list[str], reach: float = 1.0) -> DataFrame:
    """Missed notes whose key another voice of the staff has within a beat, and which was struck there: (id).

    Notes have (id, staff, midi, voice, beat, matched). Both sides are dealt out to
    beats, so that a key written very often meets only its neighbours.
    """
    bucket = F.floor(F.col("beat") / reach)
    lost = notes.where(~F.col("matched")).select(*keys, "id", "staff", "midi", "voice", "beat", bucket.alias("_b"))
    struck = notes.where("matched").select(*keys, "staff", "midi", F.col("voice").alias("_v"), F.col("beat").alias("_t"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    apart = F.abs(F.col("beat") - F.col("_t"))
    return lost.join(struck, [*keys, "staff", "midi", "_b"]).where((F.col("voice") != F.col("_v")) & (apart > 0) & (apart <= reach)).select(*keys, "id").distinct()


def regions(spans: DataFrame, keys: list[str], seq: str, error: str, bad: float = 0.5, rest: float = 0.05, least: int = 2) -> DataFrame:
    """Runs of bad spans while the rest is clean: (first, last, n)."""
    w = Window.partitionBy(*keys).orderBy(seq)
    b = spans.withColumn("bad", F.col(error) >= bad)
    share = F.avg(F.when(~F.col("bad"), F.col(error))).over(Window.partitionBy(*keys))
    b = b.withColumns({"other": F.coalesce(share, F.lit(0.0)), "turn": F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w)})
    held = b.where(F.col("bad") & (F.col("other") < rest)).groupBy(*keys, "turn").agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.count("*").alias("n"))
    return held.where(F.col("n") >= least).drop("turn")


def refusals(s: DataFrame) -> DataFrame:
    """Why a rhythm score is refused: from excluded, bad_measures, coverage (shares) and tempo."""
    c = F.col
    return s.withColumn("refused", named({"too_many_excluded": c("excluded") > 0.3, "measure_length": c("bad_measures") > 0.25, "low_coverage": c("coverage") < 0.3, "tempo_implausible": ~c("tempo").between(15, 360)}))
