"""Syncmer fingerprints, importance resampling and conversation repair against brute force and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from truth import ALNUM, fold

from tidemark.llm import conversations, resampling, syncmers

DOCS = "doc_id long, text string, part string, guard int, digest long, score int, rank int"


def documents(spark, rows):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 7, 3, 1, 2) for i, t in rows], DOCS)


# -- syncmers ---------------------------------------------------------------


def test_anchors_are_context_free_and_every_passage_has_them():
    rng = random.Random(1)
    letters = "abcé𝄞 "
    for n in (0, 1, 15, 16, 17, 200, 3000):
        text = "".join(rng.choice(letters) for _ in range(n))
        hashes, places = syncmers.anchors_of(text)
        assert len(hashes) == len(places) and (n == 0) == (len(places) == 0)
        if n >= 2 * syncmers.K:  # any window of 2K - S code points has an anchor
            gaps = np.diff(np.concatenate([[-1], places, [n - syncmers.K + 1]]))
            assert gaps.max() <= syncmers.K - syncmers.S + 1
            moved, at = syncmers.anchors_of("prefix of another text " + text + " and more")
            known = dict(zip((at - 23).tolist(), moved.tolist()))
            assert all(known[p] == h for h, p in zip(hashes.tolist(), places.tolist()))


def test_anchors_are_closed_syncmers():
    """The inner runs' order is that of one text; an anchor is where the least stands at an edge."""
    rng = random.Random(2)
    k, s = 9, 4
    text = "".join(rng.choice("abcd") for _ in range(500))
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    # With k = s a run is its own anchor, so these are the hashes of all inner runs, up to one mixing that differs.
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(syncmers.W.mix(code.astype(np.uint64) + np.uint64(1)) * syncmers.W._power(syncmers._BASE, len(code)), dtype=np.uint64)])
    inner = syncmers.W.mix((prefix[s:] - prefix[:-s]) * syncmers.W._power(syncmers._INVERSE, len(code))[: len(code) - s + 1]).tolist()
    assert len({(text[i : i + s], h) for i, h in enumerate(inner)}) == len({text[i : i + s] for i in range(len(inner))})
    want = [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    assert syncmers.anchors_of(text, k, s)[1].tolist() == want


def test_pieces_of_a_long_text_make_no_difference(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    whole = syncmers.anchors_of(text)
    monkeypatch.setattr(syncmers, "PIECE", 700)
    parts = syncmers.anchors_of(text)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_fingerprints_are_read_back_and_compared():
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    texts = ["", "a", "short text", prose(60), prose(4000), "x" * 500, prose(90_000)]
    for t in texts:
        one = syncmers.sketch_of(t)
        back = syncmers.read(one.written())
        assert (back.hashes == one.hashes).all() and (back.places == one.places).all() and back.full == one.full
        assert syncmers.likeness(one, back) == 1
        assert len(one.hashes) <= syncmers.KEPT and (len(t) > 0) == (len(one.hashes) > 0)
    for a, b in itertools.combinations(texts, 2):
        x, y = syncmers.sketch_of(a), syncmers.sketch_of(b)
        assert syncmers.likeness(x, y) == syncmers.likeness(y, x) and 0 <= syncmers.likeness(x, y) < 0.1
    errors = []
    for _ in range(30):  # half of a text is kept
        t, u = prose(6000), prose(6000)
        errors.append(syncmers.likeness(syncmers.sketch_of(t), syncmers.sketch_of(t[:3000] + u[:3000])) - 0.5)
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.12
    # the same passages in another order are less alike than in theirs
    a, b, c = prose(1500), prose(1500), prose(1500)
    same, turned = (syncmers.likeness(syncmers.sketch_of(a + b + c), syncmers.sketch_of(t)) for t in (a + b, c + b + a))
    assert turned < same


@pytest.mark.parametrize("part_bytes", [200, 1 << 20])
def test_edited_texts_follow_the_order_of_ids(spark, part_bytes):
    rng = random.Random(5)
    texts = [None, "", "x", "Größe 𝄞 of it", "copy of one text here and there", "copy of one text here and there"] + ["".join(rng.choice("abcdef gh") for _ in range(rng.randrange(400))) for _ in range(40)]
    ids = rng.sample(range(-500, 500), len(texts))
    docs = documents(spark, list(zip(ids, texts)))
    got = {r["doc_id"]: r for r in syncmers.edited(docs.repartition(5), part_bytes=part_bytes).collect()}
    order = sorted(zip(ids, texts))
    assert len(got) == len(order)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, other = map(syncmers.sketch_of, (t, edited, after))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own.written(), changed.written())
        assert (r["near_edited"], r["near_next"]) == (syncmers.likeness(own, changed), syncmers.likeness(own, other))
        assert (r["fingerprint"] == "") == (t == "")


def test_edited_texts_of_odd_tables(spark):
    assert syncmers.edited(documents(spark, [(1, "a")]).limit(0)).count() == 0
    one = syncmers.edited(documents(spark, [(1, "a single text")])).first()
    assert (one["near_edited"], one["near_next"]) == (syncmers.likeness(syncmers.sketch_of("a single text"), syncmers.sketch_of("a singl" + "a sing")), 1.0)
    # null ids, repeated rows and ids of several texts: each row has its answer, and rows alike answer alike but for the last
    rows = [(None, "one"), (None, "two"), (None, "one"), (3, "three"), (3, "three"), (3, "drei")]
    for size in (1, 1000):
        got = syncmers.edited(documents(spark, rows), part_bytes=size).collect()
        assert sorted((r["doc_id"] is not None, r["n_chars"]) for r in got) == sorted((i is not None, len(t)) for i, t in rows)
        assert len({r["fingerprint"] for r in got if r["n_chars"] == 3}) == 2


def test_anchors_and_likeness_are_for_joins_too(spark):
    docs = documents(spark, [(1, "the same passage stands in both of these texts"), (2, "new words; the same passage stands in both of these texts"), (3, None)])
    found = syncmers.anchors(docs)
    a, b = found.where("doc_id = 1").alias("a"), found.where("doc_id = 2").alias("b")
    shifts = {r[0] for r in a.join(b, F.col("a.hash") == F.col("b.hash")).select(F.col("b.place") - F.col("a.place")).collect()}
    assert shifts == {11} and found.where("doc_id = 3").count() == 0
    prints = syncmers.fingerprints(docs)
    pairs = prints.where("doc_id = 1").select(F.col("fingerprint").alias("x")).join(prints.where("doc_id <> 1").select("doc_id", F.col("fingerprint").alias("y")))
    near = {r["doc_id"]: r["likeness"] for r in syncmers.alike(pairs, "x", "y").collect()}
    assert near[2] > 0.6 and near[3] == 0


# -- resampling -------------------------------------------------------------


def features(text, longest=3):
    w = ALNUM.findall(fold(text))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(docs, items, percent=5, least=20, n=10_000, seed=42):
    of = lambda g: zlib.crc32(g.encode()) % n
    s, t = [0] * n, [0] * n
    for counts, texts in ((s, [x for _, x in docs]), (t, items)):
        for text in texts:
            for g in features(text)[1]:
                counts[of(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + n) / ((a + 1) * (sum(t) + n)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(gain[of(g)] for g in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    long = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(long[: percent * len(long) // 100], 1)}
    return [(*r, drawn.get(id(r))) for r in rows]


@pytest.mark.parametrize("rank_rows", [7, 1000])
def test_resampling_agrees_with_brute_force(spark, rank_rows):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"W{rng.randrange(40)}é" + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    texts = [None, "", "!?", "one", "one two", " ".join(["same"] * 30), prose(20_000), "y" * 90 + " " + "z" * 5000] + [prose(rng.randrange(60)) for _ in range(80)]
    rows = list(zip(rng.sample(range(-100, 900), len(texts)), texts)) + [(None, prose(30)), (None, None), (1000, texts[20]), (1001, texts[20])]
    items = [None, "", texts[20], texts[21], "one two three"]
    got = resampling.resample(documents(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string"), percent=30, rank_rows=rank_rows).collect()
    want = resampled(rows, items, percent=30)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r["rank"] is not None for r in got) > 5


def test_buckets_of_blocks_that_cut_a_document(monkeypatch):
    rng = random.Random(7)
    texts = ["", "a", "a b", "A b a B a b c", None, " ".join(f"w{rng.randrange(50)}é" for _ in range(3000)), "x" * 200 + " " + "y" * 70 + " z " + "x" * 200]
    want = np.zeros(97, dtype=int)
    for t in texts:
        for g in features(t)[1]:
            want[zlib.crc32(g.encode()) % 97] += 1
    for size in (7, 1000, 1 << 20):
        monkeypatch.setattr(resampling, "BLOCK_WORDS", size)
        got = sum(np.bincount(b.ravel() + 1, minlength=98) for *_, b in resampling._blocks(pa.array(texts), 97))
        assert (got[1:] == want).all()


def test_resampling_of_ties_repeats_and_empty_tables(spark):
    target = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    text = " ".join(f"w{i}" for i in range(25))
    same = resampling.resample(documents(spark, [(5, text)] * 40 + [(None, text)] * 20), target, percent=50, rank_rows=5).collect()
    assert sorted(r["rank"] for r in same if r["rank"]) == list(range(1, 31)) and len({r["score"] for r in same if r["doc_id"] == 5}) == 1
    assert resampling.resample(documents(spark, [(1, "a")]).limit(0), target).count() == 0
    none = resampling.resample(documents(spark, [(1, text)]), target.limit(0), percent=100).first()
    assert none["rank"] == 1 and none["n_features"] == 25 + 24 + 23
    docs = documents(spark, [(i, text + f" x{i}") for i in range(40)] + [(None, text)])
    drawn = resampling.draw(docs, target, percent=10)
    assert drawn.columns == docs.columns and drawn.count() == 4


# -- conversations ----------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, pos int, code string"


def damaged(rows):
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, role, text


def cheapest(turns):
    """All ways, one by one, over sequences of edits: the least (cost, audit) with what it gives."""
    legal = re.compile(r"s?(ua)*u?\Z")
    short = lambda r: ("s" if r[:1] == "s" else "") + ("" if len(r.lstrip("s")) == 0 else "ua" if len(r.lstrip("s")) % 2 == 0 else "u")
    give: dict = {"": (0, "", [])}

    def put(out, roles, cost, audit, lines):
        if not legal.match(roles):
            return
        key = short(roles)
        if key not in out or (cost, audit) < out[key][:2]:
            out[key] = (cost, audit, lines)

    def inserted(now):
        for _ in range(3):
            out = dict(now)
            for roles, (c, a, lines) in now.items():
                for x in ("user", "assistant"):
                    put(out, roles + x[0], c + 5, a + "I", lines + [(x, "")])
            now = out
        return now

    for role, text, fault in turns:
        now, out = inserted(give), {}
        for roles, (c, a, lines) in now.items():
            put(out, roles, c + 2, a + "D", lines)
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                put(out, roles + (role[:1] or "-"), c + extra, a + "K", lines + [(role, text)])
                for x in ("user", "assistant"):
                    put(out, roles + x[0], c + 1 + extra, a + "R", lines + [(x, text)])
        give = out
    final = inserted(give)
    return min((v for k, v in final.items() if re.fullmatch("(s?(ua)+)?", k)), key=lambda v: v[:2])


def repaired(rows):
    """conv_id -> the row of the contract, by plain loops."""
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], [])
    for conv, turn, role, text in damaged(rows):
        by[conv].append((turn, role, text))
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        seen, told, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
            if fault:
                n[fault] += 1
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, lines = cheapest(told) if told else (0, "", [])
        yield conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)


def talk(rng, conv, n, roles=("user", "assistant", "system", "tool", "", None)):
    lines = ["Yes.", "No!", "What?", "cut", "", " \t", None, "Said again.", "So.\n"]
    rows = []
    for turn in range(n):
        role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
        rows.append((conv, rng.choice([None, turn, turn, turn + 1]) if rng.random() < 0.2 else turn, role, rng.choice(lines) if rng.random() < 0.4 else f"Line {rng.randrange(1000)}."))
    return rows


@pytest.mark.parametrize("block", [2, 256])
def test_repair_agrees_with_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "FAN", 3)
    monkeypatch.setattr(conversations, "TASK_ROWS", 60 if block == 2 else 50_000)
    rng = random.Random(8)
    rows = [r for conv in range(60) for r in talk(rng, conv, rng.randrange(1, 14))] + talk(rng, None, 8) + talk(rng, 900, 150)
    rows += [(901, None, "user", "One."), (901, None, "user", "One."), (901, None, None, None)]
    got = conversations.report(conversations.damage(table(spark, rows)), table(spark, rows)).drop("rows").collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(repaired(rows), key=key)


def test_matrices_multiply_in_any_grouping():
    rng = random.Random(9)
    every = (0, 1, 2, 3)
    for _ in range(60):
        codes = ["".join(rng.choice("suao") + rng.choice("--tbd") for _ in range(rng.randrange(1, 6))) for _ in range(3)]
        a, b, c = ([*conversations._rows_of(x, every)] for x in codes)
        left = conversations._times(conversations._times(a, b), c)
        right = conversations._times(a, conversations._times(b, c))
        whole = conversations._rows_of("".join(codes), every)
        assert sorted(left) == sorted(right) == sorted(whole)


def test_mended_turns_are_legal_and_in_order(spark):
    rng = random.Random(10)
    rows = [r for conv in range(30) for r in talk(rng, conv, rng.randrange(1, 12))]
    turns = table(spark, rows)
    lines: dict = {}
    for r in conversations.mend(turns).coalesce(1).collect():
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"]))
    plans = {r["conv_id"]: r for r in conversations.plan(turns).collect()}
    assert set(plans) == {r[0] for r in rows}
    for conv, p in plans.items():
        told = lines.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _, _ in told))
        assert "".join(e for *_, e in told) == p["audit"].replace("D", "") and p["rows"] == sum(c != "I" for c in p["audit"])


def test_conversations_of_empty_tables_and_dropped_rows(spark):
    none = table(spark, [(1, 1, "user", "a")]).limit(0)
    assert conversations.report(conversations.damage(none), none).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = [(1, gone, "user", "Hello.")]
    got = conversations.report(conversations.damage(table(spark, rows)), table(spark, rows)).drop("rows").collect()
    assert list(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
