"""Many plain texts at once give what a parser gives of each."""

from __future__ import annotations

import json
import random
from functools import partial
from itertools import compress
from xml.etree import ElementTree

import pytest

from tidemark.sources import edit, plain, scan


def note(r, depth=0):
    grace, chord = r.random() < 0.06, r.random() < 0.2
    inner = ["<grace/>" if grace else "", r.choice(["<chord/>", "<chord />"]) if chord else ""]
    inner.append("<rest/>" if r.random() < 0.1 else f"<pitch><step>{r.choice('CDEFGAB')}</step>{r.choice(['', '', '<alter>1</alter>', '<alter>-1.0</alter>'])}<octave>{r.randint(2, 6)}</octave></pitch>")
    inner.append("" if grace else f"<duration>{r.choice(['1', '2', '4', ' 3 ', '2'])}</duration>")
    inner += [r.choice(["", "<voice>1</voice>", "<voice>2</voice> ", "<voice> </voice>"]), r.choice(["", "", "<staff>2</staff>"]), r.choice(["", "", "<accidental>sharp</accidental>", "<accidental>odd</accidental>"])]
    inner.append(r.choice(["", "", "", '<type size="cue">quarter</type>', "<dot/>", '<beam number="1">begin</beam>\n']))
    return f"<note{r.choice(['', '', ' print-object=' + chr(34) + 'no' + chr(34)])}>{''.join(inner)}</note>{r.choice(['', '', chr(10) + '  '])}"


def move(r):
    return f"<{(k := r.choice(['backup', 'forward', 'forward']))}><duration>{r.choice('0112')}</duration>{r.choice(['', '<voice>2</voice>'])}</{k}>"


def measure(r):
    head = r.choice(["", "<attributes><divisions>2</divisions><key><fifths>-2</fifths></key></attributes>", "<attributes><key><fifths>3</fifths></key></attributes>", "\n "])
    body = [note(r) if r.random() < 0.75 else r.choice([move(r), move(r), "<direction><words>a 'b' :c!</words></direction>", "<sound/>"]) for _ in range(r.randint(0, 7))]
    return f"<measure number=\"{r.randint(1, 9)}\">{head}{''.join(body)}</measure>"


ODD = [
    lambda t: t.replace("<duration>2", "<duration>2.5", 1), lambda t: t.replace("<duration>", "<duration>-", 1), lambda t: t.replace("</pitch>", "", 1), lambda t: t.replace("<part ", "<p:part xmlns:p='u' ", 1).replace("</part>", "</p:part>", 1),
    lambda t: "<?xml version='1.0'?>" + t, lambda t: t.replace("</measure>", "<!-- <note> --></measure>", 1), lambda t: t.replace("<octave>", "<octave>x", 1), lambda t: t.replace("</measure>", "&amp;</measure>"), lambda t: t + "\n", lambda t: t[:-3],
    lambda t: t.replace("score-partwise", "score-timewise"), lambda t: t.replace("<score-partwise>", '<score-partwise xmlns="urn:x">'), lambda t: t.replace("<note>", '<note><tie type="stop"/>', 1), lambda t: t.replace("number=", 'number="0" number=', 1),
    lambda t: t.replace("<measure", "<measure/><measure", 1), lambda t: t.replace("<dot/>", "<dot></dot>"), lambda t: t.replace("<voice>2", "<voice>é"), lambda t: t.replace("</part>", "</part><part><measure><note><duration>1</duration></note></measure></part>"),
    lambda t: t.replace("<part ", '<part-list><score-part id="Q"/></part-list><part ', 1), lambda t: t.replace("<divisions>2", "<divisions>two"), lambda t: t.replace("<fifths>3", "<fifths>3.0"), lambda t: t.replace("<duration>4", "<duration>99999999999999999999"),
    lambda t: t.replace("<step>C", "<step>C<x/>"), lambda t: t.replace("<pitch>", "<pitch><note><duration>1</duration></note>", 1), lambda t: f"<note><duration>1</duration></note>{t}", lambda t: t.replace(" <", "\r\n<"), lambda t: t.replace("</note>", "</note>>", 1),
]


def documents(count, seed):
    r = random.Random(seed)
    out = [None, "", "<a/>", "<a></a>", "</a><a>", "x", '<score-partwise><part id="P"/></score-partwise>']
    for k in range(count):
        text = f'<score-partwise><part id="P">{"".join(measure(r) for _ in range(r.randint(1, 3)))}</part></score-partwise>'
        out.append(r.choice(ODD)(text) if k % 3 == 0 else text)
    return out


def alone(text):
    try:
        xml, report = edit.monophonic(text)
        return xml, json.dumps(report, sort_keys=True)
    except (ElementTree.ParseError, TypeError, ValueError, AttributeError):
        return None


@pytest.mark.parametrize("seed", range(4))
def test_projection_of_many(seed):
    texts = documents(1500, seed)
    got = edit._monophonic_many(texts)
    wrong = [(t, g, alone(t)) for t, g in zip(texts, got, strict=True) if g is not None and g != alone(t)]
    assert not wrong, wrong[0]
    assert sum(g is not None for g in got) > 200
    # and it may leave to the change itself no text that is as plain as this
    plainest = '<score-partwise><part id="P"><measure><note><pitch><step>C</step><octave>4</octave></pitch><duration>1</duration></note></measure></part></score-partwise>'
    assert edit._monophonic_many([plainest]) == [alone(plainest)]


@pytest.mark.parametrize("seed", range(4))
def test_tokens_of_many(seed):
    texts = documents(1500, seed)
    of, columns, odd = scan._rows_many(texts)
    rows = {}
    for t, *row in zip(of.tolist(), *(c.tolist() for c in columns.values()), strict=True):
        rows.setdefault(t, []).append(tuple(None if v is scan.pd.NA else v for v in row))
    names = [c.split()[0] for c in scan._TOKENS.split(", ")]
    assert list(columns) == names and sum(not o for o in odd) > 800
    for t in compress(range(len(texts)), ~odd):
        assert rows.get(t, []) == list(scan._rows(texts[t])), texts[t]
    assert not set(rows) & set(compress(range(len(texts)), odd))


def test_each_distinct_piece_is_looked_into_once(monkeypatch):
    """Texts cost what their distinct tags and words cost, and arrays; no object of each tag."""
    seen = []
    monkeypatch.setattr(plain, "_piece", lambda p, look=plain._piece: seen.append(p) or look(p))
    texts = [t for t in documents(300, 3) if t] * 4
    found = plain.elements([*texts, None, ""])
    assert len(seen) == len(set(seen)) < len(found.piece) / 10
    assert [found.pieces[k] for k in found.piece[found.owner == 0]] == ["a/>"] and "".join(f"<{found.pieces[k]}" for k in found.piece[found.owner == len(texts) - 1]) in (texts[-1], "")


def test_plain_texts_are_told_apart():
    body = '<a><b x="1">t</b> <c/>\n</a>'
    odd = [None, "", " ", "t", f" {body}", f"{body}\n", f"{body}{body}", body.replace("t<", "t>t<"), body.replace('"1"', '">"'), body.replace('"1"', '"<"'), body.replace('"1"', '"\t"'), body.replace('"1"', "'1'"), body.replace("t<", "é<"), body.replace("t<", "\x7f<"), body.replace("t<", "\r<"), body.replace("t<", "\0<")]
    odd += [body.replace("t<", "&lt;<"), body[1:], body[:-1], body.replace("</b>", "</c>"), body.replace("</b>", "</b >"), body.replace("<c/>", "<c/"), body.replace("<c/>", "</c>"), body.replace("<c/>", "<p:c/>"), body.replace("<c/>", "<é/>"), body.replace("<c/>", "<!-- -->"), body.replace("x=", 'x="2" x='), "<", ">", "<>", "<<a></a>", "<a/>", "</a>"]
    usual = [body, "<a></a>", "<a><b/></a>", "<a><b /></a>", '<a><b x="/"/></a>', body.replace("t<", "'\"!~\t<")]
    found = plain.elements([t for pair in zip(odd, usual * 9) for t in pair])
    assert not found.plain[::2].any() and found.plain[1::2].all()
    assert plain.elements([]).plain.tolist() == [] and plain.elements([None]).plain.tolist() == [False]


def test_changed_and_scanned_in_spark(spark):
    texts = [t for t in documents(300, 9) if "9999999" not in (t or "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, x string").repartition(3)
    got = {r["k"]: (r["line"], r["report"]) for r in edit.edited(docs, "x", edit.monophonic, "line").collect()}
    asked = {r["k"]: (r["line"], r["report"]) for r in edit.edited(docs, "x", partial(edit.monophonic), "line").collect()}
    assert got == asked
    found = {}
    for r in scan.tokens(docs, "k", "x").orderBy("k", "part", "measure", "token").collect():
        found.setdefault(r["k"], []).append(tuple(r)[1:])
    assert found == {k: rows for k, t in enumerate(texts) if (rows := list(scan._rows(t or "")))}


def test_placed_notes_are_those_of_timed(spark):
    texts = [t for t in documents(1200, 5) if "9999999" not in (t or "")]
    texts += [t.replace("<step>C", "<step>H") for t in texts[20:25] if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, xml string").repartition(3)
    told, placed = scan.timed(scan.tokens(docs, "k", "xml"), "k"), scan.tokens(docs, "k", "xml", placed=True)
    assert sorted(told.columns) == sorted(placed.columns) and all(told.schema[c].dataType == placed.schema[c].dataType for c in told.columns)
    order = ["k", "part", "measure", "token"]
    got = placed.select(*told.columns).orderBy(*order).collect()
    assert got == told.orderBy(*order).collect() and len(got) > 3000
    assert any(r["at"] is None for r in got) and any(r["midi"] is None for r in got) and {r["alter"] for r in got} >= {-1, 0, 1}


def test_runs_hold_few_texts():
    assert [(k, len(t)) for k, t in plain.runs(["a" * 6, None, "b" * 6, "", "c" * 30], 10)] == [(0, 3), (3, 2)]
    assert list(plain.runs([])) == []
