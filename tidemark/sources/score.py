"""Scores in MusicXML: validation, notes, measure lengths, repeats, structure.

A parse needs a running cursor, so it is one vectorised Python pass that turns
documents into flat rows; everything after that is relational. A document that
can't be read becomes a row with its fault and no notes.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from fractions import Fraction
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import ready

#: Characters of a document, bytes of an unpacked one, and notes, at most.
MOST_CHARACTERS, MOST_UNPACKED, MOST_NOTES = 1_000_000, 8_000_000, 8000
#: Semitones of the steps.
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}

#: Printed accidentals, and sharps and flats in the order of key signatures.
ACCIDENTALS = {"sharp": 1, "natural": 0, "flat": -1, "double-sharp": 2, "sharp-sharp": 2, "flat-flat": -2, "natural-sharp": 1, "natural-flat": -1}
SHARPS, FLATS = "FCGDAEB", "BEADGCF"

NOTES = "part int, measure int, number string, seq int, onset double, duration double, midi int, staff int, voice string, chord boolean, rest boolean, tie string, grace boolean, kind string, dots int, beam string, beats int, unit int, fifths int, tempo double, repeat string, ending string, rolled boolean, slurs string, accidental string, moves int, transposed boolean, microtone boolean, fault string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents (path, xml); packed ones are unpacked."""
    ready(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "xml": [unpack(bytes(c)) for c in b["content"]]})

    return files.mapInPandas(run, "path string, xml string")


def unpack(data: bytes) -> str | None:
    """Text of a document, or of the first score in a packed one; null if it is neither or too large."""
    try:
        if data[:2] != b"PK":
            return data.decode("utf-8-sig") if len(data) <= MOST_UNPACKED else None
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [i for i in z.infolist() if i.filename.lower().endswith((".xml", ".musicxml")) and not i.filename.startswith("META-INF/")]
            return z.read(names[0]).decode("utf-8-sig") if names and names[0].file_size <= MOST_UNPACKED else None
    except (UnicodeDecodeError, zipfile.BadZipFile):
        return None


def fault(xml: Column) -> Column:
    """Why a document is refused before it is parsed, or null."""
    return F.when(xml.isNull(), "missing").when(F.length(xml) > MOST_CHARACTERS, "too_long").when(xml.rlike(r"(?i)<!ENTITY|<!DOCTYPE[^>]*\["), "entities")


def parse(xml: str | None) -> list[dict]:
    """Flat rows of a document, in document order; one row with a fault if it can't be read.

    Names may have a namespace. A pitch without an alteration has that of the
    measure's last one of its staff, step and octave, printed or not, else that of
    the key. Cue notes are left out.
    """
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return [{"fault": "not_xml"}]
    for node in root.iter():
        if isinstance(node.tag, str):
            node.tag = node.tag.rpartition("}")[2]
    rows: list[dict] = []
    for p, part in enumerate(root.iter("part")):
        transposed = part.find(".//transpose") is not None
        state = {"divisions": Fraction(1), "beats": 4, "unit": 4, "fifths": 0, "tempo": None}
        for m, measure in enumerate(part.findall("measure"), 1):
            at, last = Fraction(0), Fraction(0)
            altered: dict[tuple, int] = {}
            marks = {"moves": sum(n.tag in ("backup", "forward") for n in measure), "transposed": transposed, "repeat": ",".join(f"{r.get('direction')}:{r.get('times') or 2}" for r in measure.iter("repeat")) or None, "ending": ",".join(f"{e.get('type')}:{e.get('number')}" for e in measure.iter("ending")) or None}
            for seq, node in enumerate(measure):
                if node.tag == "attributes":
                    _attributes(node, state)
                elif node.tag in ("backup", "forward"):
                    step = _number(node.findtext("duration")) / state["divisions"]
                    at += step if node.tag == "forward" else -step
                    if at < 0:
                        return [{"fault": "cursor"}]
                elif node.tag in ("direction", "sound"):
                    tempo = next((s.get("tempo") for s in ([node] if node.tag == "sound" else node.iter("sound")) if s.get("tempo")), None)
                    state["tempo"] = float(tempo) if tempo else state["tempo"]
                elif node.tag == "note" and node.find("cue") is None:
                    grace, chord = node.find("grace") is not None, node.find("chord") is not None
                    length = Fraction(0) if grace else _number(node.findtext("duration")) / state["divisions"]
                    begin = last if chord else at
                    midi, fine = _sounding(node, state["fifths"], altered)
                    rows.append({
                        "rolled": node.find("notations/arpeggiate") is not None, "slurs": ",".join(f"{x.get('type')}:{x.get('number') or 1}" for x in node.findall("notations/slur")) or None, "accidental": (node.findtext("accidental") or "").strip() or None, "microtone": fine,
                        "part": p, "measure": m, "number": measure.get("number"), "seq": seq, "onset": float(begin), "duration": float(length), "midi": midi, "staff": int(node.findtext("staff") or 1), "voice": node.findtext("voice") or "1", "chord": chord,
                        "rest": node.find("rest") is not None, "tie": ",".join(sorted(t.get("type") for t in node.findall("tie"))) or None, "grace": grace, "kind": node.findtext("type"), "dots": len(node.findall("dot")),
                        "beam": next((b.text for b in node.findall("beam") if b.get("number", "1") == "1"), None), "beats": state["beats"], "unit": state["unit"], "fifths": state["fifths"], "tempo": state["tempo"], **marks, "fault": None,
                    })
                    if not chord:
                        last, at = at, at + length
    if not rows:
        return [{"fault": "no_notes"}]
    return rows if len(rows) <= MOST_NOTES else [{"fault": "too_many_notes"}]


def _number(text: str | None) -> Fraction:
    try:
        return Fraction(text or "0")
    except (ValueError, ZeroDivisionError):
        return Fraction(0)


def _attributes(node, state: dict) -> None:
    for tag, name in (("divisions", "divisions"), ("time/beats", "beats"), ("time/beat-type", "unit"), ("key/fifths", "fifths")):
        text = node.findtext(tag)
        if text and text.strip().lstrip("-").isdigit():
            state[name] = Fraction(text) if name == "divisions" and int(text) > 0 else int(text) if name != "divisions" else state[name]


def _sounding(note, fifths: int, altered: dict[tuple, int]) -> tuple[int | None, bool]:
    """(midi, whether it lies between keys) of a note, with what the measure has altered so far; the note's own alteration is kept there."""
    pitch = note.find("pitch")
    step, octave = (pitch.findtext("step"), pitch.findtext("octave")) if pitch is not None else (None, None)
    if step not in STEPS or not octave:
        return None, False
    where = (note.findtext("staff") or "1", step, octave.strip())
    said, printed = pitch.findtext("alter"), (note.findtext("accidental") or "").strip()
    alter = _number(said) if said is not None else Fraction(ACCIDENTALS[printed]) if printed in ACCIDENTALS else None
    if alter is None:
        signed = 1 if fifths > 0 and step in SHARPS[:fifths] else -1 if fifths < 0 and step in FLATS[:-fifths] else 0
        return 12 * (int(octave) + 1) + STEPS[step] + altered.get(where, signed), bool(printed)
    altered[where] = round(alter)
    return 12 * (int(octave) + 1) + STEPS[step] + round(alter), alter.denominator != 1


def _midi(pitch) -> int | None:
    if pitch is None:
        return None
    step, octave = pitch.findtext("step"), pitch.findtext("octave")
    return 12 * (int(octave) + 1) + STEPS[step] + int(float(pitch.findtext("alter") or 0)) if step in STEPS and octave else None


def events(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """One row a note or rest (``NOTES``) of each document."""
    ready(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in NOTES.split(", ")]
    schema = to_arrow_schema(documents.sparkSession.createDataFrame([], f"{key} {kind}, {NOTES}").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = dict.fromkeys(names)
        for b in batches:
            rows = []
            for k, text, bad in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [empty | {key: k} | r for r in ([{"fault": bad}] if bad else parse(text))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return documents.select(key, F.col(xml).alias("_xml"), fault(F.col(xml)).alias("_fault")).mapInArrow(run, f"{key} {kind}, {NOTES}")


def measure_starts(notes: DataFrame, key: str) -> DataFrame:
    """(measure, length, start): lengths of measures in quarters and their running sum, rest-only measures included."""
    held = notes.where("fault IS NULL").groupBy(key, "measure").agg(F.max(F.col("onset") + F.col("duration")).alias("held"), F.max(4.0 * F.col("beats") / F.col("unit")).alias("nominal"))
    length = held.withColumn("length", F.when(F.col("held") > 0, F.col("held")).otherwise(F.col("nominal")))
    before = Window.partitionBy(key).orderBy("measure").rowsBetween(Window.unboundedPreceding, -1)
    return length.select(key, "measure", "length", F.coalesce(F.sum("length").over(before), F.lit(0.0)).alias("start"))


def sounding(notes: DataFrame, key: str) -> DataFrame:
    """Notes that sound: absolute onsets, tied notes as one, in order (id from 1); ``rolled`` where a chord is written so.

    A tie goes on while the same key of a staff starts where the note before
    ends: an island over a window, so ties may cross any number of bars. A slur
    between neighbours of a voice on one key is a tie, as recognisers read it. A
    key that two voices write at once is struck once, for the longer of both.
    """
    starts = measure_starts(notes, key).select(key, "measure", "start")
    n = notes.where("fault IS NULL AND midi IS NOT NULL AND NOT grace").join(starts, [key, "measure"]).withColumn("at", F.col("start") + F.col("onset"))
    ends = F.col("at") + F.col("duration")
    begun = lambda kind: F.transform(F.filter(F.split(F.coalesce("slurs", F.lit("")), ","), lambda x: x.startswith(kind)), lambda x: F.substring_index(x, ":", -1))
    voice = Window.partitionBy(key, "part", "staff", "voice", "chord").orderBy("at", "seq")
    n = n.withColumns({"_from": F.lag(begun("start")).over(voice), "_key": F.lag("midi").over(voice), "_end": F.lag(ends).over(voice)})
    slurred = ~F.col("chord") & (F.col("_key") == F.col("midi")) & F.arrays_overlap(begun("stop"), "_from") & (F.abs(F.col("_end") - F.col("at")) < 1e-3)
    w = Window.partitionBy(key, "part", "staff", "midi").orderBy("at", "seq")
    meets = F.abs(F.lag(ends).over(w) - F.col("at")) < 1e-6
    goes_on = F.coalesce((F.col("tie").contains("stop") | F.coalesce(slurred, F.lit(False))) & meets, F.coalesce(slurred & meets, F.lit(False)))
    tied = n.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    one = tied.groupBy(key, "part", "staff", "midi", "island").agg(F.min("measure").alias("measure"), F.min("at").alias("onset"), F.max(ends).alias("stop"), F.min("voice").alias("voice"), F.bool_or(F.coalesce("rolled", F.lit(False))).alias("rolled"))
    struck = one.groupBy(key, F.round("onset", 6).alias("onset"), "midi").agg(F.min("measure").alias("measure"), F.min("staff").alias("staff"), F.min_by("voice", F.struct("staff", "voice")).alias("voice"), F.max(F.col("stop") - F.col("onset")).alias("duration"), F.bool_or("rolled").alias("rolled"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("onset", "midi", "staff"))
    return struck.select(key, rank.alias("id"), "measure", "onset", "duration", "midi", "staff", "voice", "rolled")


#: Keys of a keyboard, and of a single line; quarters of its longest note.
KEYBOARD, LINE, LONGEST = (21, 108), (36, 96), 32.0


def refusals(notes: DataFrame, key: str, single: bool = False) -> DataFrame:
    """(refused): why a document can't be scored, sorted and distinct; empty if it can.

    Any: what can't be read, ``transposing``, ``range``, ``signature``, ``no_notes``.
    A ``single`` line also must not have several ``parts``, ``voices`` or a moved
    ``cursor``, ``repeats``, another ``meter`` on the way, a ``microtone``, a
    ``length`` of nothing or of more than 32 quarters, or a ``tie`` that stops
    where the note before is another.
    """
    lo, hi = LINE if single else KEYBOARD
    struck = F.col("midi").isNotNull() & ~F.coalesce("grace", F.lit(False))
    last = F.lag("midi").over(Window.partitionBy(key).orderBy("part", "measure", "seq"))
    base = notes.where("midi IS NOT NULL AND NOT chord AND NOT grace").withColumn("_loose", F.col("tie").contains("stop") & ~F.coalesce(last == F.col("midi"), F.lit(False)))
    loose = base.groupBy(key).agg(F.bool_or(F.coalesce("_loose", F.lit(False))).alias("_tie"))
    some = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    found = notes.groupBy(key).agg(
        F.first("fault", ignorenulls=True).alias("unread"), some(F.col("transposed")).alias("transposing"), some(struck & ~F.col("midi").between(lo, hi)).alias("range"), some(~F.col("fifths").between(-7, 7)).alias("signature"),
        (~some(struck) & F.first("fault", ignorenulls=True).isNull()).alias("no_notes"), (F.count_distinct("part") > 1).alias("parts"), ((F.count_distinct("voice") > 1) | (F.count_distinct("staff") > 1)).alias("voices"), some(F.col("moves") > 0).alias("cursor"),
        some(F.col("repeat").isNotNull() | F.col("ending").isNotNull()).alias("repeats"), (F.count_distinct("beats", "unit") > 1).alias("meter"), some(F.col("microtone")).alias("microtone"),
        some(~F.coalesce("grace", F.lit(False)) & ~((F.col("duration") > 0) & (F.col("duration") <= LONGEST))).alias("length"),
    )
    found = found.join(loose, key, "left").withColumn("tie", F.coalesce("_tie", F.lit(False)))
    names = ["transposing", "range", "signature", "no_notes", *(["parts", "voices", "cursor", "repeats", "meter", "microtone", "length", "tie"] if single else [])]
    return found.select(key, F.array_sort(F.array_compact(F.array("unread", *(F.when(F.col(n), F.lit(n)) for n in names)))).alias("refused"))


def play_order(repeats: list[str | None], endings: list[str | None], most: int = 4000) -> list[int]:
    """Measures (from 1) in the order in which they are played: repeats and voltas unfolded."""
    out, k, begin, turn = [], 0, 0, 1
    open_ending = None
    while k < len(repeats) and len(out) < most:
        mark, ending = repeats[k] or "", endings[k] or ""
        if "forward" in mark and begin != k:
            begin, turn = k, 1
        for e in ending.split(","):
            if e.startswith("start"):
                open_ending = [int(x) for x in e.split(":")[1].replace(" ", ",").split(",") if x.isdigit()] or [1]
        if open_ending is None or turn in open_ending:
            out.append(k + 1)
            back = next((m for m in mark.split(",") if m.startswith("backward")), None)
            times = int(back.split(":")[1]) if back else 0
            if back and turn < max(times, 2):
                turn, k, open_ending = turn + 1, begin, None
                continue
            if back:
                begin, turn = k + 1, 1
        if any(e.startswith(("stop", "discontinue")) for e in ending.split(",")):
            open_ending = None
        k += 1
    return out


def passes(notes: DataFrame, key: str) -> DataFrame:
    """(seq, measure) of each document in performance order."""
    ready(notes.sparkSession)
    kind = notes.schema[key].dataType.simpleString()
    marks = notes.where("fault IS NULL AND part = 0").groupBy(key, "measure").agg(F.first("repeat", ignorenulls=True).alias("repeat"), F.first("ending", ignorenulls=True).alias("ending"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {int(r.measure): r for r in pdf.itertuples(index=False)}
        size = max(by)
        order = play_order([getattr(by.get(m), "repeat", None) for m in range(1, size + 1)], [getattr(by.get(m), "ending", None) for m in range(1, size + 1)])
        return pd.DataFrame({key: pdf[key].iloc[0], "seq": range(len(order)), "measure": order})

    return marks.groupBy(key).applyInPandas(fold, f"{key} {kind}, seq int, measure int")
