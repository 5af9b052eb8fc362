"""Conversation structure repair: the cheapest edits that give each conversation its turns in order.

A repaired conversation's roles read ``(s?(ua)+)?``: an optional system turn,
then user and assistant in turn. Four states tell how far that pattern has
come. A turn is a 4 x 4 matrix over (cost, audit): what it costs to keep, rerole
or delete it between two states, with the closure of inserted turns before it,
and the letters of these edits. Matrices multiply by min-plus: costs add up,
audits join, and of two ways the cheaper counts, then the one whose letters come
first. Two ways of equal cost between the same states are never a prefix of one
another (what a prefix leaves out would be insertions, which cost something), so
the smaller one stays the smaller one whatever follows, and the product is
associative: long conversations are multiplied block by block over many tasks,
then in a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch, ready, session_of

#: Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Consecutive turns of one block, blocks that a step of the tree joins, and turns that a task sorts on average.
BLOCK, FAN, TASK_ROWS = 256, 16, 50_000

#: White space of the word rule: space, tab to carriage return.
SPACES = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
ENDS = ".!?"

# States: nothing yet, system turn given, user turn given, assistant turn given (complete, as is nothing).
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a kept turn of each role does, and what a turn of the role that is due does.
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_LEGAL = {"su", "ua", "au"}

Way = tuple[int, str]
Row = dict[int, Way]


def _better(row: Row, state: int, cost: int, audit: str) -> None:
    if state not in row or (cost, audit) < row[state]:
        row[state] = (cost, audit)


def _closed(row: Row) -> Row:
    """With any turns inserted: at most two ever help, as a third leads back to a state that was there."""
    out = dict(row)
    for state, (cost, audit) in row.items():
        for k in (1, 2):
            state = _NEXT[state]
            _better(out, state, cost + INSERT * k, audit + "I" * k)
    return out


def _turn(row: Row, role: str, fault: str) -> Row:
    """One turn, after what may be inserted before it."""
    out: Row = {}
    for state, (cost, audit) in _closed(row).items():
        _better(out, state, cost + DELETE, audit + "D")
        if fault in "bd":
            continue
        cost += TRUNCATED * (fault == "t")
        if (kept := _KEEP.get(role, {}).get(state)) is not None:
            _better(out, kept, cost, audit + "K")
        _better(out, _NEXT[state], cost + REROLE, audit + "R")
    return out


@lru_cache(maxsize=1 << 14)
def _rows_of(code: str, starts: tuple[int, ...]) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, audit) of a block of turns, from the given states. Two letters a turn: role and fault."""
    found = []
    for start in starts:
        row: Row = {start: (0, "")}
        for i in range(0, len(code), 2):
            row = _turn(row, code[i], code[i + 1])
        found += [(start, state, *way) for state, way in sorted(row.items())]
    return tuple(found)


def _illegal(code: str) -> int:
    roles = code[::2]
    return sum(roles[i : i + 2] not in _LEGAL for i in range(len(roles) - 1))


def _times(a: list[tuple[int, int, int, str]], b: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """The min-plus product of two matrices, as lists of their entries."""
    out: dict[int, Row] = {}
    for x, y, c, s in a:
        row = out.setdefault(x, {})
        for y2, z, d, t in b:
            if y == y2 and (z not in row or c + d <= row[z][0]):
                _better(row, z, c + d, s + t)
    return [(x, z, *way) for x, row in out.items() for z, way in row.items()]


def _ended(entries) -> Way:
    """The best complete way from the start."""
    last = _closed({z: (c, s) for x, z, c, s in entries if x == START})
    return min(last[z] for z in (START, ASSISTANT) if z in last)


_ENTRY = T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("z", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_ARROW = pa.list_(pa.struct([("x", pa.int32()), ("z", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _counts(codes: list[str]) -> list[list[int]]:
    return [*([c[1::2].count(f) for c in codes] for f in "bdt"), [_illegal(c) for c in codes]]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one block: counts and the best way."""
    for batch in batches:
        codes = batch.column(1).to_pylist()
        ways = [_ended(_rows_of(c, (START,))) for c in codes]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _counts(codes)), pa.array([c for c, _ in ways], pa.int64()), pa.array([a for _, a in ways], pa.string())], names=["conv", *_COUNTS, "cost", "audit"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of longer ones: counts, the roles at both ends, and the matrix."""
    for batch in batches:
        codes = batch.column(2).to_pylist()
        entries = [[dict(zip(("x", "z", "cost", "audit"), e)) for e in _rows_of(c, (START, SYSTEM, USER, ASSISTANT))] for c in codes]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, _counts(codes)), pa.array([c[0] for c in codes]), pa.array([c[-2] for c in codes]), pa.array(entries, _ARROW)], names=["conv", "place", *_COUNTS, "first", "last", "entries"])


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, place, parts): the product of up to FAN matrices in order."""
    for batch in batches:
        counts, ends, made = [], [], []
        for parts in batch.column(2).to_pylist():
            total = [sum(p[k] for p in parts) for k in _COUNTS]
            total[-1] += sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(parts, parts[1:]))
            entries = None
            for p in parts:
                own = [(e["x"], e["z"], e["cost"], e["audit"]) for e in p["entries"]]
                entries = own if entries is None else _times(entries, own)
            counts.append(total)
            ends.append((parts[0]["first"], parts[-1]["last"]))
            made.append([dict(zip(("x", "z", "cost", "audit"), e)) for e in entries])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), *(pa.array([e[k] for e in ends], pa.string()) for k in (0, 1)), pa.array(made, _ARROW)], names=["conv", "place", *_COUNTS, "first", "last", "entries"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ways = [_ended((e["x"], e["z"], e["cost"], e["audit"]) for e in entries) for entries in batch.column(5).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array([c for c, _ in ways], pa.int64()), pa.array([a for _, a in ways], pa.string())], names=["conv", *_COUNTS, "cost", "audit"])


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults that crc32 of ``conv_id:turn`` chooses, one space for a null.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes out its
    ``.!?``, 3 repeats it, 4 makes it a user's. Null roles and texts become one
    space; null turns stay.
    """
    kind = F.crc32(F.concat(_text(F.col("conv_id")), F.lit(":"), _text(F.col("turn"))).cast("binary")) % 20
    held = rows.select("conv_id", "turn", _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return held.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


#: Order of a conversation's turns: by turn, nulls first; rows of one turn by role, then by the digest of their text.
def _order(*ahead: str) -> list[Column]:
    return [*(F.col(c).asc_nulls_first() for c in (*ahead, "turn")), F.col("role"), F.col("digest")]


def _slim(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def plan(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """What ails each conversation, and its cheapest repair. With ``scratch`` it lasts as long as its tables.

    Rows have conv_id (of any type that sorts), turn, role and text; null roles
    and texts count as one space; other columns are ignored. A turn's first
    fault counts: blank (nothing but white space), duplicate (role and text
    seen earlier), truncated (its last mark is none of ``.!?``). Blank and
    duplicate turns are deleted.

    Returns conv_id, gaps (turns missing between the smallest and largest;
    without turns 0), blank, duplicate, truncated, illegal (neighbours whose
    role initials are not su, ua or au), cost, audit (K keep, R rerole, D delete,
    I insert; of the cheapest the first by its letters), rows. Null is a
    conversation of its own. An empty table gives an empty result. An audit is
    one string, so a conversation has 2**31 turns at most.
    """
    spark = session_of(rows)
    ready(spark)
    scratch = scratch or Scratch(spark)
    held = _slim(rows)
    bare = F.rtrim("text", F.lit(SPACES))
    fault = F.when(bare == "", F.lit("b")).when(F.instr(F.lit(ENDS), F.substring(bare, -1, 1)) == 0, F.lit("t")).otherwise(F.lit("-"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    slim = held.select("conv", "turn", "role", _digest(F.col("text")).alias("digest"), role.alias("initial"), fault.alias("fault"))
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    # Places are those of one order of all rows, so a conversation of any length is dealt out.
    slim = slim.repartitionByRange(tasks, *_order("conv")).sortWithinPartitions(*_order("conv")).withColumn("pos", F.monotonically_increasing_id())
    slim = scratch.keep(slim, "turns", compression="zstd")
    seen = slim.where("fault <> 'b'").groupBy("conv", "role", "digest").agg(F.min("pos").alias("seen"), F.count("*").alias("n")).where("n > 1")
    seen = scratch.keep(seen.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "seen"), "seen", compression="zstd")
    again = slim.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    marked = again.select("conv", "pos", F.concat("initial", F.when((F.col("fault") != "b") & (F.col("pos") > F.col("seen")), F.lit("d")).otherwise(F.col("fault"))).alias("code"))
    blocks = marked.groupBy("conv", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("turns"))
    whole = Window.partitionBy("conv")
    blocks = blocks.select("conv", "block", F.array_join(F.transform("turns", lambda t: t["code"]), "").alias("code"))
    blocks = blocks.withColumns({"place": F.row_number().over(whole.orderBy("block")).cast("long") - 1, "blocks": F.count("*").over(whole)})
    blocks = scratch.keep(blocks.drop("block"), "blocks", compression="zstd")
    kind = slim.schema["conv"].dataType
    answer = T.StructType([T.StructField("conv", kind), *(T.StructField(c, T.LongType()) for c in (*_COUNTS, "cost")), T.StructField("audit", T.StringType())])
    found = blocks.where("blocks = 1").select("conv", "code").mapInArrow(_solve, answer)
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    if most > 1:
        node = T.StructType([T.StructField("conv", kind), *(T.StructField(c, T.LongType()) for c in ("place", *_COUNTS)), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("entries", _ENTRY)])
        level = scratch.keep(blocks.where("blocks > 1").select("conv", "place", "code").mapInArrow(_matrices, node), "matrices", compression="zstd")
        while most > 1:
            parts = level.groupBy("conv", F.floor(F.col("place") / FAN).alias("at")).agg(F.array_sort(F.collect_list(F.struct("place", *_COUNTS, "first", "last", "entries"))).alias("parts"))
            above = scratch.keep(parts.select("conv", F.col("at").alias("place"), "parts").mapInArrow(_multiply, node), "matrices", compression="zstd")
            scratch.drop(level)
            level, most = above, -(-most // FAN)
        found = found.unionAll(level.select("conv", *_COUNTS, "entries").mapInArrow(_finish, answer))
    # One row a conversation from each side: they meet in one aggregation, whatever a conversation's id is.
    turns = slim.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), F.count("*").alias("rows"))
    names = ["gaps", "rows", *_COUNTS, "cost", "audit"]
    both = turns.unionByName(found, allowMissingColumns=True).groupBy("conv").agg(*(F.max(c).alias(c) for c in names))
    return scratch.keep(both.select(F.col("conv").alias("conv_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in names[:-1]), "audit"), "plans", compression="zstd")


class _Mending:
    """One conversation as its turns come by: what each letter of the audit makes of them."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.given, self.led = conv, audit, 0, 0, 0

    def _due(self) -> str:
        return "assistant" if (self.given - self.led) % 2 else "user"

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            made = (self._due(), "", "I")
            self.at += 1
            self.given += 1
            yield made

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "K" and not self.given and role.startswith("s"):
            self.led = 1
        made = (role if edit == "K" else self._due(), text, edit)
        self.given += 1
        yield made

    end = _inserted


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, audit or null, role, text) in order, an audit ahead of its turns -> (conv, place, role, text, edit)."""
    now = None
    for batch in batches:
        kind, made = batch.schema.field(0).type, []
        for conv, audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                made += [(now.conv, *m) for m in now.end()] if now else []
                now, place = _Mending(conv, audit), 0
            else:
                made += [(conv, *m) for m in now.turn(role, text)]
        yield _table(made, kind)
    if now:
        yield _table([(now.conv, *m) for m in now.end()], kind)


def _table(made: list, kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*made)) if made else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.string()) for c in columns[1:])], names=["conv_id", "role", "text", "edit"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows -> (conv, sha256 of the repaired ``role:text`` lines); a conversation is never held whole."""
    now, sha, some = None, hashlib.sha256(), False

    def add(lines) -> None:
        nonlocal some
        for role, text, _ in lines:
            sha.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for conv, audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                if now:
                    add(now.end())
                    done.append((now.conv, sha.hexdigest()))
                now, sha, some = _Mending(conv, audit), hashlib.sha256(), False
            else:
                add(now.turn(role, text))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([s for _, s in done], pa.string())], names=["conv_id", "repaired_sha256"])
    if now:
        add(now.end())
        yield pa.RecordBatch.from_arrays([pa.array([now.conv], kind), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])


def _in_order(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv, audit, role, text): each conversation's audit, then its turns in order; one exchange of the texts."""
    texts = _slim(rows).withColumn("audit", F.lit(None).cast("string"))
    audits = plans.select(F.col("conv_id").alias("conv"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = texts.unionAll(audits).repartition("conv").withColumn("digest", _digest(F.col("text")))
    return both.sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("audit").desc_nulls_last(), *_order()).select("conv", "audit", "role", "text")


def mend(rows: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """The repaired turns: conv_id, role, text, edit (K kept, R reroled, I inserted), in order within a task.

    A conversation streams through one task, as its turns depend on what came
    before; none is held whole there. ``plans`` are those of ``plan`` for the same rows.
    """
    plans = plan(rows) if plans is None else plans
    kind = plans.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(c, T.StringType()) for c in ("role", "text", "edit"))])
    return _in_order(rows, plans).mapInArrow(_mended, schema)


def report(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """``plan``, with repaired_sha256 of the repaired ``role:text``, newline-joined.

    ``every`` may name more conversations (conv_id); those without rows get
    zeros, an empty audit and the digest of nothing. A SHA-256 has no parts that
    could be joined, so a conversation's digest is one task's work; it streams.
    """
    spark = session_of(rows)
    plans = plan(rows, Scratch(spark))
    schema = T.StructType([plans.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    digests = _in_order(rows, plans).mapInArrow(_digests, schema)
    known = (rows if every is None else every).select("conv_id").distinct()
    both = plans.unionByName(digests, allowMissingColumns=True).unionByName(known, allowMissingColumns=True)
    counts = ["gaps", "rows", *_COUNTS, "cost"]
    nothing = hashlib.sha256().hexdigest()
    return both.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))
