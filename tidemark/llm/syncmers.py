"""Document fingerprints of closed syncmers.

Of all runs of K code points those are anchors whose smallest inner run of S
code points (by hash) stands at either end. Whether a run is an anchor depends
on its own K code points alone, so a passage keeps its anchors wherever it
stands and whatever is edited around it, and any text of 2 K - S code points has
one. Anchors carry their place: passages of two texts are matched by chains of
equal anchors in the same order.

A fingerprint keeps the anchors with the smallest hashes. Two fingerprints are
compared below the smaller of their largest hashes, where both are complete, so
that the share of chained anchors estimates that of the whole texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import ready, session_of

#: Code points of an anchor, and of the inner runs.
K, S = 16, 6
#: Anchors of a fingerprint.
KEPT = 64
#: Bits of an anchor's hash, and hexadecimal digits.
BITS, DIGITS = 40, 10
#: Code points that are hashed at once: memory for a text of any length.
PIECE = 1 << 20
#: Bytes of text of one part of the order of ids, parts of a task, and parts at most (what is sent to executors has that bound).
PART_BYTES, TASK_PARTS, PARTS = 4 << 20, 4, 1 << 16

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))


@dataclass(frozen=True)
class Sketch:
    """The kept anchors in order of their hash; ``full`` where there are more."""

    hashes: np.ndarray
    places: np.ndarray
    full: bool

    def written(self) -> str:
        """``hash@place`` in hexadecimal digits, in order of place, comma-joined; a + at the end if the text has more anchors."""
        order = np.argsort(self.places, kind="stable")
        return ",".join(f"{h:0{DIGITS}x}@{p:x}" for h, p in zip(self.hashes[order].tolist(), self.places[order].tolist())) + "+" * self.full


def read(fingerprint: str) -> Sketch:
    """The sketch that was written."""
    full = fingerprint.endswith("+")
    parts = [x.split("@") for x in fingerprint.rstrip("+").split(",") if x]
    pairs = sorted((int(h, 16), int(p, 16)) for h, p in parts)
    return Sketch(np.array([h for h, _ in pairs], dtype=np.int64), np.array([p for _, p in pairs], dtype=np.int64), full)


def _smallest(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n neighbours."""
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def _piece(code: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchors of a piece, and last of its smallest run if there are none."""
    n = len(code)
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(W.mix(code.astype(np.uint64) + _U(1)) * W._power(_BASE, n), out=prefix[1:])
    back = W._power(_INVERSE, n)
    inner = W.mix((prefix[s:] - prefix[:-s]) * back[: n - s + 1])
    width = k - s + 1
    least = _smallest(inner, width)
    at = np.flatnonzero((inner[: n - k + 1] == least) | (inner[width - 1 :] == least))
    if not len(at):
        at = np.array([int(np.argmin(least))])
    return (W.mix((prefix[at + k] - prefix[at]) * back[at] + _U(k)) >> _U(64 - BITS)).astype(np.int64), at


def anchors_of(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every anchor, in order of place.

    A text of at least k code points without any has its smallest run for one; a shorter
    one, if not empty, is one anchor itself.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(code):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(code) < k:
        whole = W.mix(np.sum(W.mix(code.astype(np.uint64) + _U(1)) * W._power(_BASE, len(code)), dtype=np.uint64, keepdims=True) + _U(len(code)))
        return (whole >> _U(64 - BITS)).astype(np.int64), np.zeros(1, dtype=np.int64)
    if len(code) <= PIECE:
        return _piece(code, k, s)
    found = [(h, at + lo) for lo in range(0, len(code) - k + 1, PIECE) for h, at in [_piece(code[lo : lo + PIECE + k - 1], k, s)]]
    return np.concatenate([h for h, _ in found]), np.concatenate([at for _, at in found])


def sketch_of(text: str, k: int = K, s: int = S, kept: int = KEPT) -> Sketch:
    hashes, places = anchors_of(text, k, s)
    order = np.lexsort((places, hashes))
    hashes, places = hashes[order], places[order]
    first = np.flatnonzero(np.diff(hashes, prepend=-1) != 0)  # of a run that repeats, its first place
    return Sketch(hashes[first[:kept]], places[first[:kept]], len(first) > kept)


def likeness(a: Sketch, b: Sketch) -> float:
    """0 to 1: twice the anchors in the longest chain that both have in the same order, over the anchors of both.

    Two empty texts are alike, an empty one and another aren't.
    """
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    # Up to this hash both have all their anchors.
    top = min(int(x.hashes[-1]) for x in (a, b) if x.full) if a.full or b.full else None
    n, m = (len(x.hashes) if top is None else bisect_right(x.hashes, top) for x in (a, b))
    _, i, j = np.intersect1d(a.hashes[:n], b.hashes[:m], assume_unique=True, return_indices=True)
    tails: list[int] = []
    for p in b.places[j][np.argsort(a.places[i])].tolist():
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
    return 2 * len(tails) / (n + m)


def anchors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Every anchor of every document, for joins of passages: doc_id, hash long, place long (code points from 0).

    A null text is empty and has none. Repeated rows repeat theirs. Other columns are ignored.
    """
    ready(session_of(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                hashes, places = anchors_of(text, k, s)
                if len(hashes):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(hashes))), pa.array(hashes), pa.array(places)], names=["doc_id", "hash", "place"])

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, hash long, place long")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, kept: int = KEPT) -> DataFrame:
    """doc_id, n_chars (code points), fingerprint of every document; a null text is empty, an empty one's fingerprint too."""
    ready(session_of(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sketch_of(t, k, s, kept).written() for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def alike(pairs: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of the fingerprints in columns ``a`` and ``b``; null if one is null."""
    ready(session_of(pairs))

    @F.pandas_udf("double")
    def compare(x, y):
        return x.combine(y, lambda p, q: None if p is None or q is None else likeness(read(p), read(q)))

    return pairs.withColumn(name, compare(F.col(a), F.col(b)))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


Key = tuple[bool, int, int]


def _key(doc_id: int | None, digest: int) -> Key:
    return (doc_id is not None, doc_id or 0, digest)


def _bounds(slim: DataFrame, parts: int) -> list[Key]:
    """The first key of each part of the order: at most ``parts`` rows come to the driver."""
    ranged = slim.select("doc_id", "digest").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("digest"))
    first = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "digest")).alias("k"))
    return sorted((r["k"]["known"], r["k"]["doc_id"], r["k"]["digest"]) for r in first.toLocalIterator())


def _router(bounds_of):
    """Each document to its part of the order, and a part's first one also to the part before: there it stands for what follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = bounds_of.value
        starts = set(bounds)
        for batch in batches:
            keys = [_key(i, d) for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            part = [max(0, bisect_right(bounds, k) - 1) for k in keys]
            yield _routed(batch, part, 0)
            guards = [row for row, k in enumerate(keys) if k in starts]
            if guards:
                yield _routed(batch.take(pa.array(guards)), [(part[row] - 1) % len(bounds) for row in guards], 1)

    return run


def _routed(batch: pa.RecordBatch, part: list[int], guard: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([guard] * len(part), pa.int32()), *(batch.column(k) for k in range(3))], names=["part", "guard", "doc_id", "digest", "text"])


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _paired(k: int, s: int, kept: int):
    """Rows of whole parts in order -> a row for each but the guards, made when the next one is there."""

    def finished(doc_id, text: str, own: Sketch, following: str, other: Sketch):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        changed = own if edited == text else sketch_of(edited, k, s, kept)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.written(), changed.written(), likeness(own, changed), likeness(own, other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        waiting, part_of = None, None
        for batch in batches:
            made = []
            for part, guard, doc_id, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if part != part_of:
                    waiting, part_of = None, part
                if guard and waiting is None:  # further rows like the guard
                    continue
                own = sketch_of(text, k, s, kept)
                if waiting is not None:
                    made.append(finished(*waiting, text, own))
                waiting = None if guard else (doc_id, text, own)
            columns = list(zip(*made)) if made else [[]] * 7
            kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        W.make_room()

    return run


def edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S, kept: int = KEPT, part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    A document's edited text has the last half of its code points (rounded down)
    replaced by the first as many of the next document's in ascending order of
    id, or all of them if it has fewer; the first follows the last. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (of its fingerprint to the edited text's, to the next
    document's).

    A null text is empty. Null ids come first; rows that share an id stand in
    the order of a digest of their texts, and rows alike in both are next to
    each other, in one task, where they stream. A single document follows
    itself. Other columns are ignored; an empty table gives an empty result.

    Texts are exchanged once. The bounds of the parts are found first, from ids
    alone; each part's first document goes to the part before as well, so no
    part waits for another.
    """
    spark = session_of(docs)
    ready(spark)
    slim = _slim(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    size = slim.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = min(PARTS, max(1, -(-size // part_bytes)))
    bounds = spark.sparkContext.broadcast(_bounds(slim, parts))
    order = [F.col("part"), F.col("guard"), F.col("doc_id").asc_nulls_first(), F.col("digest")]
    routed = slim.mapInArrow(_router(bounds), "part int, guard int, doc_id long, digest long, text string")
    return routed.repartition(max(1, -(-parts // TASK_PARTS)), "part").sortWithinPartitions(*order).mapInArrow(_paired(k, s, kept), _EDITED)
