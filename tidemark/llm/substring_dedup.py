"""Exact substring deduplication over word windows.

A word goes if a window of ``n`` words over it also starts in a document with a
smaller id. Passages that can repeat are found first, by hashes: windows are
represented by minimisers (few, and the same for equal windows), and only
windows whose minimiser occurs in several documents are hashed one by one; of
each that recurs, the smallest document is its owner.

The owners' passages are the reference. It is cut into shards of bounded size,
each of which becomes a suffix automaton over words whose states know the
smallest document that reaches them. The other documents' passages are streamed
through the automata of their owners' shards for matching statistics: the
longest match that ends at each word, and the smallest document with its last
``n`` words. Those decide what goes; hashes only choose what is compared.

Shards are joined with the passages that need them, as a reference that grows
with the corpus must not be broadcast. A shard that many passages need is dealt
out to several tasks, each with its own automaton, and equal passages are
streamed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import Scratch, materialize, ready, release, session_of

WINDOW = 50
#: Words that a minimiser spans.
SEED_WORDS = 8
#: Words of the reference in one automaton, and of passages streamed by one task, on average.
SHARD_WORDS, STREAM_WORDS = 100_000, 400_000

_U = np.uint64


def _minimisers(w: W.Words, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash, first window, windows) of each document's runs of windows with one minimiser."""
    span = n - SEED_WORDS + 1
    seeds = W.ngrams(w.value, SEED_WORDS)
    first = w.first.tolist()
    for d in range(len(w)):
        lo, hi = first[d], first[d + 1]
        if hi - lo < n:
            continue
        own = seeds[lo : hi - SEED_WORDS + 1]
        at = _argmins(own, span)
        edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        yield w.doc + d, own[at[edge]], edge, np.diff(np.concatenate((edge, [len(at)])))


def _argmins(x: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest value (the first, of equals) of every run of ``span`` values."""
    best = np.arange(len(x))
    size = 1
    while 2 * size <= span:  # doubling: best of runs of 2, 4, 8, ...
        a, b = best[: len(best) - size], best[size:]
        best = np.where(x[b] < x[a], b, a)
        size *= 2
    rest = span - size
    if rest:
        a, b = best[: len(best) - rest], best[rest:]
        best = np.where(x[b] < x[a], b, a)
    return best


def _anchors(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        for batch in batches:
            for w in W.words(batch.column(2), W.SPACED, fold=False):
                parts = list(_minimisers(w, n))
                if not parts:
                    continue
                rows = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
                anchor, at, size = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(W.as_long(anchor)), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))], names=["anchor", "doc_id", "text_key", "at", "size"])

    return run


def _passages(n: int):
    """Texts and their candidate windows -> passages: words from the first window's to the last's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        for batch in batches:
            runs = batch.column(3)
            edge, ats, sizes = np.asarray(runs.offsets), np.asarray(runs.values.field("at")), np.asarray(runs.values.field("size"))
            for w in W.words(batch.column(2), W.SPACED, fold=False, hashed=False):
                rows, at, texts = [], [], []
                for d in range(len(w)):
                    row, first = w.doc + d, int(w.first[d])
                    mine = slice(edge[row], edge[row + 1])
                    order = np.argsort(ats[mine], kind="stable")
                    lo, hi = ats[mine][order].tolist(), (ats[mine] + sizes[mine])[order].tolist()
                    k = 0
                    while k < len(lo):
                        begin, end = lo[k], hi[k]
                        k += 1
                        while k < len(lo) and lo[k] <= end:  # windows that follow each other are one passage
                            end = max(end, hi[k])
                            k += 1
                        rows.append(row)
                        at.append(begin)
                        texts.append(w.spell(first + begin, first + end - 1 + n).decode())
                if rows:
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "text_key", "at", "passage"])

    return run


def _windows(n: int):
    """Distinct passages -> a row for each window: its hash, the passage's key, its place, and the documents' range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        for batch in batches:
            for w in W.words(batch.column(1), W.SPACED, fold=False):
                grams = W.ngrams(w.value, n)
                count = np.maximum(np.diff(w.first) - n + 1, 0)
                rows = np.repeat(np.arange(len(w)), count)
                place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
                take = pa.array(rows + w.doc)
                yield pa.RecordBatch.from_arrays([pa.array(W.as_long(grams[w.first[:-1][rows] + place])), batch.column(0).take(take), pa.array(place.astype(np.int32)), batch.column(2).take(take), batch.column(3).take(take)], names=["window", "key", "i", "lo", "hi"])

    return run


class Automaton:
    """A suffix automaton over word numbers; states know the smallest document that reaches them."""

    def __init__(self, n: int):
        self.n = n
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]
        self.last = 0

    def add(self, words: list[int], doc: int) -> None:
        """One more reference text; its words may be in the automaton already."""
        step, link, length, least = self.step, self.link, self.length, self.least
        last = 0
        for c in words:
            if c in step[last]:
                q = step[last][c]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(last, q, c)
            else:
                now = len(step)
                step.append({})
                length.append(length[last] + 1)
                link.append(0)
                least.append(1 << 62)
                p = last
                while p != -1 and c not in step[p]:
                    step[p][c] = now
                    p = link[p]
                if p != -1:
                    q = step[p][c]
                    link[now] = q if length[q] == length[p] + 1 else self._split(p, q, c)
                last = now
            if doc < least[last]:
                least[last] = doc

    def _split(self, p: int, q: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.least.append(1 << 62)
        link[q] = copy
        while p != -1 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    def finish(self) -> None:
        """Hand each state's smallest document on to its suffixes."""
        for v in sorted(range(1, len(self.step)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if up > 0 and self.least[v] < self.least[up]:
                self.least[up] = self.least[v]

    def owners(self, words: list[int], none: int | None = -1) -> list[int | None]:
        """For each window of the text: the smallest document that has it, or ``none``.

        Matching statistics, cut at n words: after each word the longest suffix
        of at most n words that occurs, with its state.
        """
        step, link, length, least, n = self.step, self.link, self.length, self.least, self.n
        state, size, out = 0, 0, []
        for i, c in enumerate(words):
            while state and c not in step[state]:
                state = link[state]
                size = length[state]
            if c in step[state]:
                state = step[state][c]
                size += 1
            if size > n:
                size = n
            while state and length[link[state]] >= size:  # the state that holds the suffix of that size
                state = link[state]
            if i >= n - 1:
                out.append(least[state] if size == n else none)
        return out


def _stream(n: int):
    def run(reference: pa.Table, passages: pa.Table) -> pa.Table:
        found: dict[str, list] = {"key": [], "owner": []}
        if reference.num_rows and passages.num_rows:
            number: dict[str, int] = {}
            machine = Automaton(n)
            for doc, text in sorted(zip(reference.column("owner").to_pylist(), reference.column("passage").to_pylist(), strict=True)):
                machine.add([number.setdefault(x, len(number)) for x in text.split(" ")], doc)
            machine.finish()
            for key, text in zip(passages.column("key").to_pylist(), passages.column("passage").to_pylist(), strict=True):
                found["key"].append(key)
                found["owner"].append(machine.owners([number.get(x, -1) for x in text.split(" ")], None))
        return pa.table({"key": pa.array(found["key"], pa.binary()), "owner": pa.array(found["owner"], pa.list_(pa.int64()))})

    return run


def _owned(n: int):
    """Passages with the owners of their windows -> runs of windows with one owner, and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        for batch in batches:
            own = batch.column(4)
            edge, spots, ids = np.asarray(own.offsets), np.asarray(own.values.field("i")), np.asarray(own.values.field("owner"))
            rows, at, owner, texts = [], [], [], []
            for row, passage in enumerate(batch.column(1).to_pylist()):
                mine = slice(edge[row], edge[row + 1])
                order = np.argsort(spots[mine], kind="stable")
                i, o = spots[mine][order], ids[mine][order]
                words = passage.split(" ")
                cut = (np.flatnonzero((np.diff(i) != 1) | (np.diff(o) != 0)) + 1).tolist()
                for a, b in zip([0, *cut], [*cut, len(i)], strict=True):
                    rows.append(row)
                    at.append(int(i[a]))
                    owner.append(int(o[a]))
                    texts.append(" ".join(words[i[a] : i[b - 1] + n]))
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), batch.column(3).take(take), pa.array(at, pa.int32()), pa.array(owner, pa.int64()), pa.array(texts, pa.string())], names=["key", "lo", "hi", "at", "owner", "run"])

    return run


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def _cut(n: int):
    """Texts and the windows that go -> what is left of each document."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        for batch in batches:
            gone = batch.column(2)
            if gone.null_count:
                gone = gone.fill_null(pa.scalar([], gone.type))
            edge, flat = np.asarray(gone.offsets), np.asarray(gone.values)
            rows = batch.num_rows
            n_words, n_removed, digest, where = np.zeros(rows, np.int64), np.zeros(rows, np.int64), [_EMPTY] * rows, [[]] * rows
            for w in W.words(batch.column(1), W.SPACED, fold=False, hashed=False):
                for d in range(len(w)):
                    row, lo, hi = w.doc + d, int(w.first[d]), int(w.first[d + 1])
                    n_words[row] = hi - lo
                    starts = flat[edge[row] : edge[row + 1]]
                    flags = np.zeros(hi - lo + 1, dtype=np.int32)
                    if len(starts):
                        np.add.at(flags, starts, 1)
                        np.add.at(flags, starts + n, -1)
                    out = np.cumsum(flags)[:-1] > 0
                    n_removed[row] = int(out.sum())
                    digest[row] = hashlib.sha256(_spell(w, lo, hi, out)).hexdigest()
                    if n_removed[row]:
                        turn = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
                        where[row] = [{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_removed), pa.array(digest), pa.array(where, span)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return run


_EMPTY = hashlib.sha256(b"").hexdigest()


def _spell(w: W.Words, lo: int, hi: int, out: np.ndarray) -> bytes:
    """The kept words, joined by one space."""
    if hi == lo:
        return b""
    keep = np.flatnonzero(~out) + lo
    return b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True))


def _digest(*parts) -> Column:
    """SHA-256 of strings: texts are told apart by it, and never by a shorter hash alone."""
    return F.unhex(F.sha2(F.concat_ws(":", *parts), 256))


def repeated_windows(docs: DataFrame, *, n: int = WINDOW, shard_words: int = SHARD_WORDS, stream_words: int = STREAM_WORDS) -> DataFrame:
    """(doc_id, text_key, starts) of documents (doc_id, text_key, text): windows that a smaller document holds too."""
    spark = session_of(docs)
    scratch = Scratch(spark)
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    # 1. Which passages can repeat: minimisers that several documents share.
    anchors = scratch.keep(known.mapInArrow(_anchors(n), "anchor long, doc_id long, text_key long, at int, size int"), "anchors", compression="zstd")
    # Written, so that Spark may split a minimiser that very many documents share when it joins.
    shared = scratch.keep(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "shared")
    likely = anchors.join(shared, "anchor", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "size")).alias("runs"))
    found = known.join(likely, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "runs").mapInArrow(_passages(n), "doc_id long, text_key long, at int, passage string")
    passages = scratch.keep(found.withColumn("sha", _digest("passage")), "passages", compression="zstd")
    scratch.drop(anchors, shared)
    release(spark)
    # 2. Windows that recur, and their owners. Equal passages are one, and have a number from here on.
    once = passages.groupBy("sha").agg(F.first("passage").alias("passage"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    distinct = scratch.keep(once.withColumn("key", F.monotonically_increasing_id()), "distinct", compression="zstd")
    places = scratch.keep(passages.select("doc_id", "text_key", "at", "sha").join(distinct.select("sha", "key"), "sha").drop("sha"), "places", compression="zstd")
    scratch.drop(passages)
    release(spark)
    rows = distinct.select("key", "passage", "lo", "hi").mapInArrow(_windows(n), "window long, key long, i int, lo long, hi long")
    # Aggregated and joined back, so that a window that very many passages share is summed before it moves, and split after.
    again = rows.groupBy("window").agg(F.min("lo").alias("owner"), F.max("hi").alias("top")).where("owner < top").select("window", "owner")
    again = scratch.keep(again, "recurring", compression="zstd")
    release(spark)
    own = rows.select("window", "key", "i").join(again, "window").groupBy("key").agg(F.collect_list(F.struct("i", "owner")).alias("owners"))
    made = distinct.join(own, "key").select("key", "passage", "lo", "hi", "owners").mapInArrow(_owned(n), "key long, lo long, hi long, at int, owner long, run string")
    made = made.withColumn("run_key", _digest(F.col("owner").cast("string"), "run")).withColumn("words", F.regexp_count("run", F.lit(" ")) + 1)
    runs = scratch.keep(made, "runs", compression="zstd")
    scratch.drop(distinct, again)
    release(spark)
    # 3. Reference shards and the passages that need them.
    reference = runs.where("owner = lo").select("owner", F.col("run").alias("passage"), "run_key", "words").dropDuplicates(["run_key"])
    shards = max(1, -(-(reference.agg(F.sum("words")).first()[0] or 0) // shard_words))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int")
    asked = runs.where("hi > owner").groupBy("run_key").agg(F.first("owner").alias("owner"), F.first("run").alias("passage"), F.first("words").alias("words")).withColumn("shard", shard)
    asked = scratch.keep(asked, "asked", compression="zstd")
    parts = scratch.keep(asked.groupBy("shard").agg(F.ceil(F.sum("words") / F.lit(stream_words)).cast("int").alias("parts")), "parts")
    asked = asked.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("run_key"), F.col("parts")).cast("int")).select("shard", "part", F.col("run_key").alias("key"), "passage")
    held = reference.withColumn("shard", shard).join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "part", "owner", "passage")
    decided = held.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(_stream(n), "key binary, owner array<long>")
    decided = scratch.keep(decided.select(F.col("key").alias("run_key"), F.col("owner").alias("least")), "decided", compression="zstd")
    # 4. Back to passages, then to their documents.
    per_passage = runs.select("key", "run_key", F.col("at").alias("from")).join(decided, "run_key").select("key", "from", "least")
    spots = places.join(per_passage, "key")
    starts = F.filter(F.transform("least", lambda o, k: F.when(o < F.col("doc_id"), F.col("at") + F.col("from") + k)), lambda x: x.isNotNull())
    spots = spots.select("doc_id", "text_key", starts.alias("starts")).where(F.size("starts") > 0)
    gone = materialize(spots.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "windows", compression="zstd")
    scratch.drop()
    release(spark)
    return gone


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW, shard_words: int = SHARD_WORDS, stream_words: int = STREAM_WORDS) -> DataFrame:
    """What is left of each document without windows that a smaller document holds too.

    Words are runs without space, tab to carriage return, unchanged. Windows
    are judged on the input. Returns doc_id, n_words, n_removed, kept_sha256
    (of the kept words, joined by one space), spans (removed word ranges).

    A null text has no words. A document with a null id keeps all and takes
    from none. Rows that share an id are one document's, and never take from
    each other; equal rows get equal results. Other columns are ignored. An
    automaton is built of about ``shard_words`` words, and a shard whose passages
    have more than ``stream_words`` is dealt out to several tasks.
    """
    ready(session_of(docs))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    gone = repeated_windows(slim.select("doc_id", "text_key", "text"), n=n, shard_words=shard_words, stream_words=stream_words)
    joined = slim.join(gone, ["doc_id", "text_key"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_cut(n), _KEPT)
