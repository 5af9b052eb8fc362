"""Changes to score documents."""

from __future__ import annotations

import json
from functools import partial

import pytest

from tidemark.sources import edit, score

XML = """<score-partwise><part id="A"><measure number="1"><attributes><divisions>2</divisions></attributes><note><pitch><step>B</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice></note>
<note><chord/><pitch><step>D</step><octave>5</octave></pitch><duration>2</duration><voice>1</voice></note><forward><duration>2</duration></forward><note><pitch><step>C</step><alter>1</alter><octave>5</octave></pitch><duration>4</duration><voice>1</voice></note>
<backup><duration>8</duration></backup><note><pitch><step>E</step><octave>3</octave></pitch><duration>8</duration><voice>2</voice></note></measure></part><part id="B"><measure number="1"><note><pitch><step>E</step><octave>3</octave></pitch><duration>8</duration></note></measure></part></score-partwise>"""


def pitches(xml):
    """(quarters from the start, midi); a measure is as long as what it holds."""
    rows, start, out = score.parse(xml), 0.0, []
    for m in sorted({r["measure"] for r in rows}):
        mine = [r for r in rows if r["measure"] == m]
        out += [(start + r["onset"], r["midi"]) for r in mine if r["midi"] is not None]
        start += max(r["onset"] + r["duration"] for r in mine)
    return out


def test_transposition_moves_every_pitch():
    for d in (-12, 1, 3, 12):
        assert [m for _, m in pitches(edit.transpose(XML, d))] == [m + d for _, m in pitches(XML)]


def test_projection_keeps_one_voice_in_time():
    xml, report = edit.monophonic(XML)
    assert pitches(xml) == [(0.0, 71), (2.0, 73)]
    assert report == {"line": ["1", "1"], "parts_dropped": 1, "lines_dropped": 1, "chord_notes_dropped": 1, "other_notes_dropped": 1, "overlaps_dropped": 0, "rests_added": 1, "orphan_ties_dropped": 0, "timeline_removed": 2}
    assert edit.monophonic(xml)[0] == xml


def line(step, more="", length=1, voice=1, octave=3):
    return f"<note>{more}<pitch><step>{step}</step><octave>{octave}</octave></pitch><duration>{length}</duration><voice>{voice}</voice></note>"


def document(*measures, head="<score-partwise>", rest=""):
    body = "".join(f"<measure>{'<attributes><divisions>1</divisions></attributes>' if k == 0 else ''}{m}</measure>" for k, m in enumerate(measures))
    return f'{head}<part id="P1">{body}</part>{rest}</score-partwise>'


def forward(n):
    return f"<forward><duration>{n}</duration></forward>"


def backup(n):
    return f"<backup><duration>{n}</duration></backup>"


def projected(*measures, **how):
    xml, report = edit.monophonic(document(*measures, **how))
    return pitches(xml), report, xml


def test_projection_of_each_case():
    # a second voice after a backup moves nothing; nor do further chord notes
    assert projected(line("C") + line("D") + backup(2) + line("G", length=2, voice=2))[0] == [(0, 48), (1, 50)]
    assert projected(line("C") + line("G", "<chord/>") + line("D"))[0] == [(0, 48), (1, 50)]
    # a forward is time, at the end of a measure too; that of another voice isn't the line's
    assert projected(line("C") + forward(2) + line("D"))[0] == [(0, 48), (3, 50)]
    assert projected(line("C") + forward(3), line("D"))[0] == [(0, 48), (4, 50)]
    assert projected(line("C") + "<forward><duration>3</duration><voice>2</voice></forward>", line("D"))[0] == [(0, 48), (1, 50)]
    # staff tells lines of one voice apart
    low = line("C", "<staff>2</staff>", octave=2)
    assert projected(line("C") + line("D") + backup(2) + low)[0] == [(0, 48), (1, 50)]
    # of notes that overlap the later goes
    got, report, _ = projected(line("C", length=2) + backup(1) + line("D") + line("E"))
    assert got == [(0, 48), (2, 52)] and report["overlaps_dropped"] == 1
    # grace notes take no time
    grace = "<note><grace/><pitch><step>B</step><octave>3</octave></pitch><voice>1</voice></note>"
    assert [m for _, m in projected(grace + line("C"))[0]][-1] == 48


def test_projection_of_ties():
    got, report, xml = projected(line("C") + line("G", '<chord/><tie type="start"/>') + line("G", '<tie type="stop"/>'))
    assert report["orphan_ties_dropped"] == 1 and "tie" not in xml and [m for _, m in got] == [48, 55]
    kept = projected(line("C", '<tie type="start"/>') + line("C", '<tie type="stop"/>'))
    assert kept[1]["orphan_ties_dropped"] == 0 and kept[2].count("<tie") == 2
    # a rest between, or another pitch, breaks a tie; the sign in the notations goes with it
    noted = line("C", '<tie type="stop"/><notations><tied type="stop"/><tied type="start"/></notations>')
    broken = projected(line("C", '<tie type="start"/>') + forward(1) + noted)
    assert broken[1]["orphan_ties_dropped"] == 1 and broken[2].count('type="stop"') == 0 and broken[2].count("<tied") == 1


def test_projection_of_namespaces_parts_and_faults():
    head = '<score-partwise xmlns="urn:x"><part-list><score-part id="P1"/><part-group/><score-part id="P2"/></part-list>'
    xml, report = edit.monophonic(document(line("C") + forward(1) + line("D"), head=head, rest='<part id="P2"><measure><note><rest/><duration>4</duration></note></measure></part>'))
    assert report["parts_dropped"] == 1 and xml.count("score-part ") == 1 and "part-group" not in xml and "ns0" not in xml
    assert xml.count("<rest") == 1 and edit.monophonic(xml)[0] == xml
    ended = edit.monophonic(document(line("C") + '<barline><repeat direction="backward"/></barline>'))[0]
    assert ended.index("<barline>") > ended.index("<note>")
    for bad in (document(backup(1) + line("C")), document(line("C", length=0)), document(line("C", length=-1)), document("<note><rest/><duration>1</duration></note>"), "<score-timewise/>", document(line("C") + forward("-1"))):
        with pytest.raises(ValueError):
            edit.monophonic(bad)


def test_a_dropped_measure_is_restored():
    xml = edit.restore_first_rest(document(line("C") + line("D"), line("E")), 3)
    assert pitches(xml) == [(3.0, 48), (4.0, 50), (5.0, 52)]
    assert [f'number="{k}"' in xml for k in (1, 2, 3, 4)] == [True, True, True, False] and xml.count("<divisions>") == 1 and 'measure="yes"' in xml
    for beats, text in ((0, document(line("C"))), (17, document(line("C"))), (2, "<score-partwise><part><measure/></part></score-partwise>"), (2, "<score-partwise/>")):
        with pytest.raises(ValueError):
            edit.restore_first_rest(text, beats)


def test_documents_and_timing(spark):
    d = spark.createDataFrame([("a", XML), ("b", "no"), ("c", None)], "k string, x string")
    got = {r["k"]: r for r in edit.edited(d, "x", partial(edit.transpose, semitones=2)).collect()}
    assert pitches(got["a"]["edited"])[0] == (0.0, 73) and got["b"]["edited"] is None and json.loads(got["b"]["report"]) == {"fault": "ParseError"} and got["c"]["edited"] is None
    t = spark.createDataFrame([('var preload = {"version":"1","times":[0,1.5],"meters":{"1":3}};',), ("nothing",)], "t string")
    got = [r["timing"] for r in edit.timing(t, "t").collect()]
    assert got[0]["times"] == [0.0, 1.5] and got[0]["meters"] == {"1": 3} and got[1] is None
