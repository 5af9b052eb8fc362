"""Recordings, scores, MIDI and rasters made in the tests."""

from __future__ import annotations

import io
import struct
import wave
import zipfile

import numpy as np
import pytest

from tidemark.operators import calibration, raster
from tidemark.sources import score, signal

RATE = 22_050
XML = """<score-partwise><part id="P"><measure number="1"><attributes><divisions>2</divisions><time><beats>4</beats><beat-type>4</beat-type></time></attributes>
<note><pitch><step>A</step><octave>4</octave></pitch><duration>4</duration><voice>1</voice></note><note><chord/><pitch><step>C</step><alter>1</alter><octave>5</octave></pitch><duration>4</duration></note>
<note><pitch><step>B</step><octave>4</octave></pitch><duration>4</duration><tie type="start"/></note></measure><measure number="2"><note><pitch><step>B</step><octave>4</octave></pitch><duration>2</duration><tie type="stop"/></note>
<note><rest/><duration>6</duration></note><barline><repeat direction="backward"/></barline></measure></part></score-partwise>"""


def wav(x, rate=RATE, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return out.getvalue()


def tone(midi, seconds=1.0, cents=0.0):
    t = np.arange(int(RATE * seconds)) / RATE
    return 0.4 * np.sin(2 * np.pi * 440 * 2 ** ((midi - 69 + cents / 100) / 12) * t)


def test_pitch_of_clean_and_detuned_tones(spark):
    clean, detuned = np.concatenate([tone(m) for m in (69, 71, 60)]), np.concatenate([tone(69), tone(71, cents=60), tone(60)])
    takes = spark.createDataFrame([("clean", wav(clean)), ("detuned", wav(detuned)), ("bad", b"xx"), ("quiet", wav(clean * 0)), ("stereo", wav(clean, channels=2)), ("none", None)], "k string, c binary")
    f = signal.frames(takes, "k", "c").toPandas()
    assert {k: v for k, v in zip(f.k, f.fault, strict=True) if v} == {"bad": "not_wav", "quiet": "silent", "stereo": "format", "none": "missing"}
    for take, want in (("clean", (69, 71, 60)), ("detuned", (69, 71.6, 60))):
        g = f[f.k == take]
        for i, m in enumerate(want):
            assert abs(g[(g.t > i + 0.2) & (g.t < i + 0.8)].midi.median() - m) < 0.1


def test_score_rows_ties_and_faults(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("score.xml", XML)
    assert score.unpack(packed.getvalue()) == XML and score.unpack(b"PKbroken") is None
    d = spark.createDataFrame([("s", XML), ("e", "<!ENTITY x>"), ("n", "nope"), ("z", None)], "k string, x string")
    n = score.events(d, "k", "x").cache()
    assert {r["k"]: r["fault"] for r in n.where("fault IS NOT NULL").collect()} == {"e": "entities", "n": "not_xml", "z": "missing"}
    got = [tuple(r) for r in score.sounding(n, "k").orderBy("id").select("measure", "onset", "duration", "midi").collect()]
    assert got == [(1, 0.0, 2.0, 69), (1, 0.0, 2.0, 73), (1, 2.0, 3.0, 71)]
    assert [r["measure"] for r in score.passes(n, "k").orderBy("seq").collect()] == [1, 2, 1, 2]


@pytest.mark.parametrize(
    ("repeats", "endings", "want"),
    [
        ([None, "backward:2", None], [None] * 3, [1, 2, 1, 2, 3]),
        (["forward:2", None, "backward:2", None], [None, "start:1", "stop:1", "start:2,stop:2"], [1, 2, 3, 1, 4]),
        ([None, "forward:2", "backward:3"], [None] * 3, [1, 2, 3, 2, 3, 2, 3]),
    ],
)
def test_repeats_unfold(repeats, endings, want):
    assert score.play_order(repeats, endings) == want


def test_midi_notes_pair_in_order(spark):
    track = b"".join([b"\x00\xff\x51\x03\x07\xa1\x20", b"\x00\x90\x45\x40", b"\x60\x45\x00", b"\x00\x90\x47\x50", b"\x30\x80\x47\x00", b"\x00\xff\x2f\x00"])
    data = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 96) + b"MTrk" + struct.pack(">I", len(track)) + track
    got = signal.midi_notes(spark.createDataFrame([("m", data)], "k string, c binary"), "k", "c").orderBy("onset").collect()
    assert [tuple(r)[1:] for r in got] == [(0.0, 0.5, 69, 64), (0.5, 0.75, 71, 80)]


def test_bar_lines_of_a_drawn_staff(spark):
    page = np.full((60, 200), 255, np.uint8)
    page[20:41:5, 10:190] = 0
    for x in (10, 70, 130, 189):
        page[20:41, x] = 0
    page[20:32, 100] = 0  # a stem
    rows = raster.columns(spark.createDataFrame([(1, 200, 60, page.tobytes())], "k int, w int, h int, px binary"), "k", "w", "h", "px")
    bars = raster.bars(rows, "k")
    assert [round(r["place"] * 5) for r in bars.orderBy("place").collect()] == [10, 70, 130, 189]
    assert raster.measures(bars, "k").count() == 3


def test_models_of_a_take_and_their_refusal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    rows = [(1, float(a), float(b), float(a > 0)) for a, b in x] + [(2, float(a), float(b), float(rng.random() > 0.5)) for a, b in x] + [(3, 0.0, 0.0, 1.0)]
    got = calibration.strike_probabilities(spark.createDataFrame(rows, "k int, a double, b double, l double"), "k", ["a", "b"], "l").groupBy("k").agg({"p": "count"}).collect()
    assert {r["k"]: r["count(p)"] for r in got} == {1: 80, 2: 0, 3: 0}
    cents = spark.createDataFrame([(1, p, 3.0 if p != 64 else 40.0) for p in range(48, 84) for _ in range(3)], "k int, p int, c double")
    r = calibration.tuning(cents, "k", "p", "c").first()
    assert r["off"] == [64] and abs(r["centre"] - 3.0) < 0.5


def bar(*notes, head="", divisions=2):
    return f"<measure>{head or f'<attributes><divisions>{divisions}</divisions></attributes>'}{''.join(notes)}</measure>"


def written(step, octave=4, length=2, pitch="", more=""):
    return f"<note>{more}<pitch><step>{step}</step>{pitch}<octave>{octave}</octave></pitch><duration>{length}</duration></note>"


def whole(*measures, head="<score-partwise>", part=""):
    return f"{head}<part>{part}{''.join(measures)}</part></score-partwise>"


def test_alterations_hold_to_the_end_of_a_measure():
    sharp, printed = "<alter>1</alter>", "<accidental>{}</accidental>"
    key = "<attributes><divisions>2</divisions><key><fifths>-2</fifths></key></attributes>"
    first = bar(written("B"), written("B", pitch="<alter>0</alter>"), written("B"), written("B", octave=3), written("F", pitch=sharp), written("F"), head=key)
    second = bar(written("B"), written("F"), written("E", more=printed.format("natural")), written("E"), head=" ")
    rows = score.parse(whole(first, second, head='<score-partwise xmlns="urn:x">'))
    assert [r["midi"] for r in rows] == [70, 71, 71, 58, 66, 66, 70, 65, 64, 64]
    cue = whole(bar(written("C"), written("D", more="<cue/>"), written("E")))
    assert [(r["onset"], r["midi"]) for r in score.parse(cue)] == [(0.0, 60), (1.0, 64)]


def test_slurs_that_are_ties_and_shared_noteheads(spark):
    slur = lambda kind, number=1: f'<notations><slur type="{kind}" number="{number}"/></notations>'
    tied = whole(bar(written("C", more=slur("start")), written("C", more=slur("stop"))), bar(written("C", more=slur("start")), written("D", more=slur("stop")), written("D"), head=" "))
    other = whole(bar(written("C", more=slur("start", 2)), written("C", more=slur("stop", 1))))
    shared = whole(bar(written("G", length=4) + "<backup><duration>4</duration></backup>" + written("G", length=2, more="<voice>2</voice>") + written("A", more="<voice>2</voice><notations><arpeggiate/></notations>")))
    docs = spark.createDataFrame([("tied", tied), ("other", other), ("shared", shared)], "k string, x string")
    got: dict = {}
    for r in score.sounding(score.events(docs, "k", "x"), "k").orderBy("k", "id").collect():
        got.setdefault(r["k"], []).append((r["onset"], r["duration"], r["midi"], r["rolled"]))
    assert got == {"tied": [(0.0, 2.0, 60, False), (2.0, 1.0, 60, False), (3.0, 1.0, 62, False), (4.0, 1.0, 62, False)], "other": [(0.0, 1.0, 60, False), (1.0, 1.0, 60, False)], "shared": [(0.0, 2.0, 67, False), (1.0, 1.0, 69, True)]}


def test_what_can_not_be_scored_is_refused(spark):
    fine = bar(written("C"), written("D"))
    meter = lambda n: f"<attributes><divisions>2</divisions><time><beats>{n}</beats><beat-type>4</beat-type></time></attributes>"
    cases = {
        "fine": (whole(fine), [], []), "xml": ("<a", ["not_xml"], ["not_xml"]), "rests": (whole(bar("<note><rest/><duration>2</duration></note>")), ["no_notes"], ["no_notes"]),
        "transposing": (whole(bar(written("C"), head="<attributes><divisions>2</divisions><transpose><chromatic>-2</chromatic></transpose></attributes>")), ["transposing"], ["transposing"]),
        "low": (whole(bar(written("C", octave=1))), [], ["range"]), "lowest": (whole(bar(written("C", octave=0))), ["range"], ["range"]), "key": (whole(bar(written("C"), head="<attributes><divisions>2</divisions><key><fifths>9</fifths></key></attributes>")), ["signature"], ["signature"]),
        "moved": (whole(bar(written("C"), "<backup><duration>2</duration></backup>", written("E", more="<voice>2</voice>"))), [], ["cursor", "voices"]), "repeat": (whole(bar(written("C"), '<barline><repeat direction="backward"/></barline>')), [], ["repeats"]),
        "meter": (whole(bar(written("C"), head=meter(4)), bar(written("D"), head=meter(3))), [], ["meter"]), "between": (whole(bar(written("C", pitch="<alter>0.5</alter>"))), [], ["microtone"]), "long": (whole(bar(written("C", length=90))), [], ["length"]),
        "loose": (whole(bar(written("C"), written("D", more='<tie type="stop"/>'))), [], ["tie"]), "held": (whole(bar(written("C", more='<tie type="start"/>'), written("C", more='<tie type="stop"/>'))), [], []),
        "two": ("<score-partwise>" + f"<part>{fine}</part>" * 2 + "</score-partwise>", [], ["parts"]), "null": (None, ["missing"], ["missing"]),
    }
    notes = score.events(spark.createDataFrame([(k, x) for k, (x, *_) in cases.items()], "k string, x string"), "k", "x").cache()
    for single in (False, True):
        assert {r["k"]: r["refused"] for r in score.refusals(notes, "k", single).collect()} == {k: c[1 + single] for k, c in cases.items()}
