"""Changes to score documents: XML in, XML and a report out, as vectorised functions."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from fractions import Fraction
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ready

from . import plain
from .score import STEPS, _midi

#: Spelling of the pitch classes where a transposition leaves the key open.
SPELLED = [("C", 0), ("C", 1), ("D", 0), ("E", -1), ("E", 0), ("F", 0), ("F", 1), ("G", 0), ("A", -1), ("A", 0), ("B", -1), ("B", 0)]


def transpose(xml: str, semitones: int) -> str:
    """Every pitch moved; whole octaves keep the spelling."""
    root = ElementTree.fromstring(xml)
    for pitch in root.iter("pitch"):
        midi = _midi(pitch)
        if midi is None:
            continue
        if semitones % 12 == 0:
            pitch.find("octave").text = str(int(pitch.findtext("octave")) + semitones // 12)
            continue
        step, alter = SPELLED[(midi + semitones) % 12]
        pitch.find("step").text = step
        node = pitch.find("alter")
        if node is not None:
            pitch.remove(node)
        if alter:
            node = ElementTree.Element("alter")
            node.text = str(alter)
            pitch.insert(1, node)
        pitch.find("octave").text = str((midi + semitones - STEPS[step] - alter) // 12 - 1)
    return ElementTree.tostring(root, encoding="unicode")


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _all(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [n for n in node if _local(n) == name]


def _one(node: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next(iter(_all(node, name)), None)


def _said(node: ElementTree.Element, name: str, default: str) -> str:
    found = _one(node, name)
    return default if found is None or not (found.text or "").strip() else found.text.strip()


def _line_of(node: ElementTree.Element) -> tuple[str, str]:
    """The voice and staff that a note or forward belongs to."""
    return _said(node, "voice", "1"), _said(node, "staff", "1")


def _length(node: ElementTree.Element, *, zero: bool) -> Fraction:
    length = Fraction(_said(node, "duration", "0"))
    if length < 0 or not (zero or length):
        raise ValueError("a length must be a positive number")
    return length


def _written(x: Fraction) -> str:
    return str(x.numerator) if x.denominator == 1 else repr(float(x))


class _Projection:
    """One line of one part, measure by measure."""

    def __init__(self, line: tuple[str, str], space: str):
        self.line, self.space, self.tied = line, space, None
        self.report = {"chord_notes_dropped": 0, "other_notes_dropped": 0, "overlaps_dropped": 0, "rests_added": 0, "orphan_ties_dropped": 0, "timeline_removed": 0}

    def _placed(self, measure: ElementTree.Element) -> tuple[list, Fraction]:
        """The line's notes with their starts and lengths, and where its own forwards reach; all of the timeline is taken out."""
        at, head, reach, notes = Fraction(0), Fraction(0), Fraction(0), []
        for node in [n for n in measure if _local(n) in ("note", "backup", "forward")]:
            measure.remove(node)
            if _local(node) != "note":
                step = _length(node, zero=True)
                at += step if _local(node) == "forward" else -step
                if at < 0:
                    raise ValueError("a backup must not pass the measure's start")
                if _local(node) == "forward" and _line_of(node) == self.line:
                    reach = max(reach, at)
                self.report["timeline_removed"] += 1
                continue
            length = Fraction(0) if _one(node, "grace") is not None else _length(node, zero=False)
            chord = _one(node, "chord") is not None
            if not chord:
                head, at = at, at + length
            if chord:
                self.report["chord_notes_dropped"] += _line_of(node) == self.line
                self.report["other_notes_dropped"] += _line_of(node) != self.line
            elif _line_of(node) != self.line:
                self.report["other_notes_dropped"] += 1
            else:
                notes.append((head, length, node))
        return sorted(notes, key=lambda n: n[0]), reach

    def _rest(self, length: Fraction) -> ElementTree.Element:
        self.tied = None
        self.report["rests_added"] += 1
        rest = ElementTree.Element(f"{self.space}note")
        ElementTree.SubElement(rest, f"{self.space}rest")
        ElementTree.SubElement(rest, f"{self.space}duration").text = _written(length)
        return rest

    def _plain(self, note: ElementTree.Element) -> ElementTree.Element:
        """Without voice and staff, and without the end of a tie that no kept note of its pitch began."""
        for node in [*_all(note, "voice"), *_all(note, "staff")]:
            note.remove(node)
        pitch = _one(note, "pitch")
        sign = None if pitch is None else tuple(_said(pitch, k, "0" if k == "alter" else "") for k in ("step", "alter", "octave"))
        kinds = {t.get("type") for t in _all(note, "tie")}
        if "stop" in kinds and (sign is None or sign != self.tied):
            for parent in [note, *_all(note, "notations")]:
                for node in [n for n in parent if _local(n) in ("tie", "tied") and n.get("type") == "stop"]:
                    parent.remove(node)
            self.report["orphan_ties_dropped"] += 1
        self.tied = sign if "start" in kinds else None
        return note

    def measure(self, measure: ElementTree.Element) -> None:
        timeline = [k for k, n in enumerate(measure) if _local(n) in ("note", "backup", "forward")]
        notes, reach = self._placed(measure)
        line, end = [], Fraction(0)
        for start, length, note in notes:
            if start < end:
                self.report["overlaps_dropped"] += 1
                continue
            if start > end:
                line.append(self._rest(start - end))
            line.append(self._plain(note))
            end = start + length
        if reach > end:
            line.append(self._rest(reach - end))
        for k, node in enumerate(line, timeline[0] if timeline else 0):
            measure.insert(k, node)


def monophonic(xml: str) -> tuple[str, dict]:
    """One part's one line, a note at a time, and a report of what went.

    The part, and in it the voice and staff, with most notes that are struck (no
    further chord notes) stay, the first in the document of equals. Chords keep
    their first note; of notes that overlap, the later goes. Rests keep what
    backups and forwards said of time, at a measure's end too. Ends of ties whose
    beginning went are dropped. Documents may have a namespace. One that isn't
    score-partwise, has no pitched note, or has impossible lengths raises ValueError.
    """
    root = ElementTree.fromstring(xml)
    parts = _all(root, "part")
    if _local(root) != "score-partwise" or not parts:
        raise ValueError("a document in parts is needed")
    space = root.tag[: root.tag.rindex("}") + 1] if "}" in root.tag else ""
    if space:
        ElementTree.register_namespace("", space[1:-1])
    struck = {id(p): [n for m in _all(p, "measure") for n in _all(m, "note") if _one(n, "pitch") is not None and _one(n, "chord") is None] for p in parts}
    part = max(parts, key=lambda p: len(struck[id(p)]))
    lines = Counter(_line_of(n) for n in struck[id(part)])
    if not lines:
        raise ValueError("a pitched note is needed")
    for other in parts:
        if other is not part:
            root.remove(other)
    for listed in _all(root, "part-list"):
        for node in list(listed):
            if _local(node) != "score-part" or node.get("id") != part.get("id"):
                listed.remove(node)
    told = _Projection(lines.most_common(1)[0][0], space)
    for measure in _all(part, "measure"):
        told.measure(measure)
    return ElementTree.tostring(root, encoding="unicode"), {"line": list(told.line), "parts_dropped": len(parts) - 1, "lines_dropped": len(lines) - 1, **told.report}


def _count(text: str) -> int:
    """A length of plain digits; others are left to the exact way."""
    if not (text.isascii() and text.isdigit() and len(text) < 10):
        raise ValueError("not in plain digits")
    return int(text)


def _monophonic_many(texts: list[str | None]) -> list[tuple[str, str] | None]:
    """What ``monophonic`` and its report's JSON say of plain texts of one part, all at once; None where that needs it.

    Left to it are texts with ties, overlaps, part lists, impossible or broken lengths, empty elements of two tags, and
    measures of which nothing stays.
    """
    x = plain.elements(texts)
    good, n, up = x.plain.copy(), len(x.text), x.parent
    above = lambda mask: (up >= 0) & mask[up]
    root, part = x.level == 1, x.named("part") & (x.level == 2)
    measure = x.named("measure") & above(part)
    node = x.named("note", "backup", "forward") & above(measure)
    note = node & x.named("note")
    good[x.text[(root & ~x.named("score-partwise")) | x.named("tie", "tied", "part-list")]] = False
    good[x.text[x.leaf & (x.stop < x.end) & (x.said == x.said_nothing)]] = False
    good &= np.bincount(x.text[part], minlength=len(texts)) == 1
    # Of each note or move: what its own first elements of a name say, and which it has.
    at, numbers = np.flatnonzero(node), np.full(n + 1, -1)
    numbers[at] = np.arange(len(at))

    def told(name: str, parse, default):
        own, first = np.unique(up[which := np.flatnonzero(x.named(name) & above(node))], return_index=True)
        values, failed = x.parsed(which[first], parse, default)
        good[x.text[own[failed]]] = False
        out = np.full(len(at), default, dtype=object if isinstance(default, str) else np.int64)
        out[numbers[own]] = values
        return out

    def has(name: str) -> np.ndarray:
        out = np.zeros(len(at), dtype=bool)
        out[numbers[up[x.named(name) & above(node)]]] = True
        return out

    length = told("duration", lambda t: _count(t.strip() or "0"), 0)
    voice, staff = (pd.factorize(told(k, lambda t: t.strip() or "1", "1")) for k in ("voice", "staff"))
    line = voice[0] * (len(staff[1]) + 1) + staff[0]
    chord, grace, pitch = has("chord"), has("grace"), has("pitch")
    text, bar = x.text[at], up[at]
    is_note, ahead = note[at], x.named("forward")[at]
    length[grace & is_note] = 0
    good[text[is_note & ~grace & (length == 0)]] = False
    # The line: most notes that are struck, the first of equals.
    struck = np.flatnonzero(is_note & pitch & ~chord)
    pairs, first, count = np.unique(np.stack([text[struck], line[struck]]), axis=1, return_index=True, return_counts=True) if len(struck) else (np.zeros((2, 0), int), np.zeros(0, int), np.zeros(0, int))
    order = np.lexsort((first, -count, pairs[0]))
    of, lead = np.unique(pairs[0][order], return_index=True)
    chosen, lines = np.full(len(texts), -1), np.bincount(pairs[0], minlength=len(texts))
    chosen[of] = pairs[1][order[lead]]
    good &= chosen >= 0
    mine = line == chosen[text]
    # Places from each measure's start.
    step = np.where(is_note, np.where(chord, 0, length), np.where(ahead, length, -length))
    total = np.cumsum(step)
    opening = np.ones(len(at), dtype=bool)
    opening[1:] = bar[1:] != bar[:-1]
    after = total - (total - step)[np.flatnonzero(opening)][np.cumsum(opening) - 1] if len(at) else total
    good[text[~is_note & (after < 0)]] = False
    reach = np.zeros(n + 1, dtype=np.int64)
    np.maximum.at(reach, bar[ahead & mine], after[ahead & mine])
    kept = np.flatnonzero(is_note & ~chord & mine)
    kept = kept[np.lexsort((kept, (after - step)[kept], bar[kept]))]
    start, owner = (after - step)[kept], bar[kept]
    close = start + length[kept]
    same = owner[1:] == owner[:-1]
    good[text[kept[1:][same & (start[1:] < close[:-1])]]] = False
    pause = start - np.concatenate([[0], np.where(same, close[:-1], 0)])[: len(kept)]
    ended = np.zeros(n + 1, dtype=np.int64)
    ended[owner] = close  # the last of a measure stays
    bars = np.flatnonzero(measure)
    held = np.bincount(owner, minlength=n + 1) + np.bincount(up[np.flatnonzero(above(measure) & ~node)], minlength=n + 1) + (reach > ended)
    good[x.text[bars[(held[bars] == 0) & (x.said[bars] == x.said_nothing)]]] = False

    tally = lambda mask: np.bincount(text[mask], minlength=len(texts)).tolist()
    rests = (np.bincount(text[kept[pause > 0]], minlength=len(texts)) + np.bincount(x.text[bars[(reach > ended)[bars]]], minlength=len(texts))).tolist()
    chords, others, moves = tally(is_note & chord & mine), tally(is_note & ~mine), tally(~is_note)
    # The text, by pieces: all but the timeline stays where it is, the line goes to the timeline's first place.
    fine = good[text[kept]]
    kept, owner, pause = kept[fine], owner[fine], pause[fine]

    def within(which: np.ndarray) -> np.ndarray:
        """The pieces of these elements; none of them holds another."""
        edge = np.zeros(len(x.piece) + 1, dtype=np.int8)
        edge[x.opens[which]] += 1
        edge[x.closes[which] + 1] -= 1
        return np.cumsum(edge[:-1]) > 0

    fixed = np.flatnonzero(~within(at) & good[x.owner])
    place = np.zeros(n + 1, dtype=np.int64)
    place[bar[opening]] = x.opens[at[opening]]
    size = (x.closes - x.opens + 1)[at[kept]]
    which = np.repeat(np.arange(len(kept)), size)
    own = np.arange(len(which)) + np.repeat(x.opens[at[kept]] - (np.cumsum(size) - size), size)
    stays = ~within(np.flatnonzero(x.named("voice", "staff") & above(note)))[own]
    which, own = which[stays], own[stays]
    # A rest ahead of a note, or at a measure's end, is five pieces of its own.
    before, ends = np.flatnonzero(pause > 0), np.flatnonzero(reach > ended)
    ends = ends[good[x.text[ends]]]
    lengths, code = np.unique(np.concatenate([pause[before], (reach - ended)[ends]]), return_inverse=True)
    rests_at = place[np.concatenate([owner[before], ends])]
    first = len(x.pieces)
    pieces = np.concatenate([x.piece[fixed], x.piece[own], np.stack([np.full(len(code), first), np.full(len(code), first + 1), first + 4 + code, np.full(len(code), first + 2), np.full(len(code), first + 3)], axis=1).ravel()])
    places = np.concatenate([fixed, place[owner][which], np.repeat(rests_at, 5)])
    ranks = np.concatenate([np.zeros(len(fixed), np.int64), 2 * which + 1, np.repeat(np.concatenate([2 * before, np.full(len(ends), 2 * len(kept))]), 5)])
    order = np.argsort(places * (2 * len(kept) + 1) + ranks, kind="stable")
    told = [p.replace(" />", "/>").replace("/>", " />") for p in x.pieces] + ["note>", "rest />", "/duration>", "/note>", *(f"duration>{k}" for k in lengths.tolist())]
    edges = np.concatenate([[0], np.cumsum(np.bincount(x.owner[places], minlength=len(texts)))])
    out = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array([f"<{p}" for p in told], pa.string()).take(pa.array(pieces[order]))), "").to_pylist()
    heads = [json.dumps([v, s]) for v in voice[1] for s in [*staff[1], ""]]
    made: list[tuple[str, str] | None] = []
    for t, fine in enumerate(good.tolist()):
        if not fine:
            made.append(None)
            continue
        made.append((out[t], f'{{"chord_notes_dropped": {chords[t]}, "line": {heads[chosen[t]]}, "lines_dropped": {lines[t] - 1}, "orphan_ties_dropped": 0, "other_notes_dropped": {others[t]}, "overlaps_dropped": 0, "parts_dropped": 0, "rests_added": {rests[t]}, "timeline_removed": {moves[t]}}}'))
    return made


#: Changes that have a way for many texts at once; where it gives None, the change itself is asked.
_MANY = {monophonic: _monophonic_many}


def restore_first_rest(xml: str, beats: int) -> str:
    """A measure of rest of so many quarters, 1 to 16, ahead of the first, where a recogniser dropped it.

    Key, time, clef and divisions move to it, and measures are numbered anew. A
    first measure without divisions, or a document without any, raises ValueError.
    """
    root = ElementTree.fromstring(xml)
    part = _one(root, "part")
    first = None if part is None else _one(part, "measure")
    attributes = None if first is None else _one(first, "attributes")
    if not 1 <= beats <= 16 or attributes is None:
        raise ValueError("1 to 16 quarters, and a measure with attributes, are needed")
    divisions = Fraction(_said(attributes, "divisions", "0"))
    if divisions <= 0:
        raise ValueError("divisions must be positive")
    space = root.tag[: root.tag.rindex("}") + 1] if "}" in root.tag else ""
    if space:
        ElementTree.register_namespace("", space[1:-1])
    opening = ElementTree.Element(f"{space}measure")
    first.remove(attributes)
    opening.append(attributes)
    rest = ElementTree.SubElement(opening, f"{space}note")
    ElementTree.SubElement(rest, f"{space}rest", {"measure": "yes"})
    ElementTree.SubElement(rest, f"{space}duration").text = _written(divisions * beats)
    part.insert(list(part).index(first), opening)
    for number, measure in enumerate(_all(part, "measure"), 1):
        measure.set("number", str(number))
    return ElementTree.tostring(root, encoding="unicode")


def edited(documents: DataFrame, xml: str, change: Callable[[str], str | tuple[str, dict]], name: str = "edited") -> DataFrame:
    """Adds the changed document and ``report`` (JSON); what can't be read is null with its fault in the report."""
    ready(documents.sparkSession)

    @F.pandas_udf("xml string, report string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        many = _MANY.get(change, lambda run: [None] * len(run))
        for text, known in ((t, k) for _, held in plain.runs(list(texts)) for t, k in zip(held, many(held), strict=True)):
            if known:
                out.append(known)
                continue
            try:
                got = change(text)
                out.append(got if isinstance(got, str) else (got[0], json.dumps(got[1], sort_keys=True)))
                out[-1] = (out[-1], "{}") if isinstance(out[-1], str) else out[-1]
            except (ElementTree.ParseError, TypeError, ValueError, AttributeError) as e:
                out.append((None, json.dumps({"fault": type(e).__name__})))
        return pd.DataFrame(out, columns=["xml", "report"])

    made: Column = run(F.col(xml))
    return documents.withColumn("_e", made).select(*documents.columns, F.col("_e.xml").alias(name), F.col("_e.report").alias("report"))


#: Fixed value: schema of an imported timing document.
TIMING = "version string, times array<double>, loop struct<from:int,to:int>, meters map<string,int>, bars map<string,int>"


def timing(documents: DataFrame, text: str) -> DataFrame:
    """Timing documents as columns, whether plain JSON or assigned to a variable in a script; unreadable ones are null."""
    body = F.regexp_extract(F.col(text), r"(?s)(\{.*\})", 1)
    return documents.withColumn("timing", F.from_json(F.when(body != "", body), TIMING))
