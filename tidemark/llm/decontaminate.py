"""Benchmark decontamination.

The normalised n-grams of all benchmark items form a hash set, which is
broadcast; documents' windows are scanned against it, every hit is verified on
its words, and hit spans or whole documents can be removed.

The set is a few flat arrays: sorted window hashes, where each window starts,
and the items' words. A benchmark of any size is dealt out to blocks, and the
documents are scanned once for each, so that driver and workers hold one block
at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import Scratch, materialize, ready, session_of, unused

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in one broadcast set. A set takes about 6 bytes for each.
BLOCK_BYTES = 8 << 20
#: Bits of a filter that spares most windows the search among hashes.
_FILTER = 1 << 20

_SPAN = "array<struct<start:bigint,end:bigint>>"
_U = np.uint64


class WindowSet:
    """Windows of benchmark items: by hash for the scan, by words for the proof."""

    def __init__(self, names: pa.Array, texts: pa.Array, n: int):
        known = names.dictionary_encode()
        self.n, self.names = n, known.dictionary.to_pylist()
        item = np.asarray(known.indices.fill_null(-1)).astype(np.int32)
        spelt, starts, ends = [], [], []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        words_before, bytes_before = 0, 0
        for w in W.words(texts, W.ALNUM, fold=True):
            size = w.end - w.start
            at = np.cumsum(size + 1) - size - 1  # words follow each other, one space between
            spelt.append(np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8))
            spelt[-1][np.repeat(at, size) + _within(size)] = w.data[np.repeat(w.start, size) + _within(size)]
            starts.append(at + bytes_before)
            ends.append(at + size + bytes_before)
            count = np.diff(w.first)
            for length in np.unique(np.minimum(count, n)).tolist():
                if not length:
                    continue
                docs = np.flatnonzero(count == length if length < n else count >= n)
                many = count[docs] - length + 1
                first = np.repeat(w.first[docs], many) + _within(many)
                found.setdefault(length, []).append((W.ngrams(w.value, length)[first], first + words_before, np.repeat(item[w.doc + docs], many)))
            words_before += len(size)
            bytes_before += len(spelt[-1])
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.spelt, self.start, self.end = join(spelt, np.uint8), join(starts, np.int64), join(ends, np.int64)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.filter: dict[int, np.ndarray] = {}
        for length, parts in found.items():
            hashes, first, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.windows[length] = hashes[order], first[order].astype(np.int32), owner[order]
            bits = np.zeros(_FILTER, dtype=bool)
            bits[(hashes >> _U(44)).astype(np.int64)] = True
            self.filter[length] = np.packbits(bits)

    def size(self) -> int:
        """Bytes of its arrays."""
        return sum(x.nbytes for x in (self.spelt, self.start, self.end, *self.filter.values(), *(y for z in self.windows.values() for y in z)))

    def hits(self, w: W.Words) -> dict[int, tuple[np.ndarray, set[int]]]:
        """Of each document with hits: a flag for each word, and the items found."""
        out: dict[int, tuple[np.ndarray, set[int]]] = {}
        for size, (known, first, owner) in self.windows.items():
            grams = W.ngrams(w.value, size)
            spot = (grams >> _U(44)).astype(np.int64)
            near = np.flatnonzero(self.filter[size][spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1)
            lo, hi = np.searchsorted(known, grams[near], "left"), np.searchsorted(known, grams[near], "right")
            docs = np.searchsorted(w.first, near, side="right") - 1
            real = (lo < hi) & (near + size <= w.first[docs + 1])
            for k, d, a, b in zip(near[real].tolist(), docs[real].tolist(), lo[real].tolist(), hi[real].tolist(), strict=True):
                text = w.spell(k, k + size)
                # Windows with one hash are nearly always the same words, of several items.
                items = {int(i) for f, i in zip(first[a:b].tolist(), owner[a:b].tolist(), strict=True) if self.spelt[self.start[f] : self.end[f + size - 1]].tobytes() == text}
                if not items:
                    continue
                if d not in out:
                    out[d] = (np.zeros(w.first[d + 1] - w.first[d], dtype=bool), set())
                flags, seen = out[d]
                flags[k - w.first[d] : k - w.first[d] + size] = True
                seen |= items
        return out


def _within(size: np.ndarray) -> np.ndarray:
    """0 .. size-1 for each size, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def spans(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _blocks(items: DataFrame, item_col: str, text_col: str, n: int, block_bytes: int) -> Iterator[WindowSet]:
    """The items' windows, in blocks of about block_bytes of text; each distinct row once."""
    rows = items.select(F.col(item_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    count = max(1, -(-total // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(count)))
    for b in range(count):
        part = rows.where(F.col("block") == b).select("name", "text").toArrow()
        yield WindowSet(part["name"].combine_chunks(), part["text"].combine_chunks(), n)


def _found(texts: DataFrame, blocks: Iterable[WindowSet], scratch: Scratch) -> DataFrame | None:
    """(key, items, spans) of the distinct texts (one column) with hits, of all blocks together; none without blocks.

    Each block is broadcast for one scan, whose hits are written; then it is
    let go. A text's key is its SHA-256, so equal texts become one row.
    """
    spark, parts = scratch.spark, []
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        hits = texts.mapInArrow(_hitter(shared), _HITS).groupBy("key").agg(F.first("items").alias("items"), F.first("spans").alias("spans"))
        parts.append(scratch.keep(hits, "hits"))
        shared.destroy()
    if not parts:
        return None
    # As many rows of a key as there are blocks, at most.
    lists = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return lists.mapInArrow(_united, _HITS)


def scan(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Contamination of every document.

    Words are maximal runs of ASCII letters, digits and non-ASCII characters,
    A-Z lower-cased. A window is n consecutive words of an item; an item of
    fewer words (but not none) is one window. Returns one row a document:
    id, n_words, n_hit (words inside any occurrence of a window), items (names
    of items that occur, sorted as strings), spans (hit word ranges).

    The first block's scan gives every document's row; what further blocks
    find joins it by the text's SHA-256.

    A null or empty text has no words and no hits. An item with a null text is
    skipped; one with a null name marks words but isn't named. Repeated rows
    each get their row; equal item rows count once. Other columns are ignored.
    Empty tables give an empty result or no hits.
    """
    spark = session_of(docs)
    ready(spark)
    scratch = Scratch(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(items, item_col, item_text_col, n, block_bytes)
    rows = f"id {docs.schema[id_col].dataType.simpleString()}, key string, n_words long, items array<string>, spans {_SPAN}"
    found = slim.mapInArrow(_scanner(spark.sparkContext.broadcast(next(blocks))), rows)
    more = _found(slim.select("text").where("text IS NOT NULL"), blocks, scratch)
    if more is not None:
        more = materialize(more.select("key", F.col("items").alias("items_too"), F.col("spans").alias("spans_too")), "hits")
        scratch.drop()
        none = F.array()
        both = found.join(more, "key", "left").withColumns({"items": F.concat("items", F.coalesce("items_too", none.cast("array<string>"))), "spans": F.concat("spans", F.coalesce("spans_too", none.cast(_SPAN)))})
        found = both.select("id", "key", "n_words", "items", "spans").mapInArrow(_united, rows)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")


_SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


_HITS = f"key string, items array<string>, spans {_SPAN}"


def _key(data: np.ndarray) -> str:
    return hashlib.sha256(data).hexdigest()


def _scanner(shared):
    """(id, text) -> a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        known = shared.value
        for batch in batches:
            rows = batch.num_rows
            n_words = np.zeros(rows, dtype=np.int64)
            items: list = [[]] * rows
            where: list = [[]] * rows
            at, data = W.string_buffers(batch.column(1))
            key = [_key(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            for w in W.words(batch.column(1), W.ALNUM, fold=True):
                n_words[w.doc : w.doc + len(w)] = np.diff(w.first)
                for d, (flags, found) in known.hits(w).items():
                    items[w.doc + d] = sorted(known.names[i] for i in found if i >= 0)
                    where[w.doc + d] = spans(flags)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.string()), pa.array(n_words), pa.array(items, pa.list_(pa.string())), pa.array(where, _SPAN_LIST)], names=["id", "key", "n_words", "items", "spans"])

    return run


def _hitter(shared):
    """Texts -> a row for each with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        known = shared.value
        for batch in batches:
            key, items, where = [], [], []
            at, data = W.string_buffers(batch.column(0))
            for w in W.words(batch.column(0), W.ALNUM, fold=True):
                for d, (flags, found) in known.hits(w).items():
                    key.append(_key(data[at[w.doc + d] : at[w.doc + d + 1]]))
                    items.append([known.names[i] for i in found if i >= 0])
                    where.append(spans(flags))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(items, pa.list_(pa.string())), pa.array(where, _SPAN_LIST)], names=["key", "items", "spans"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names once and in order; spans that touch or overlap become one."""
    for batch in batches:
        where = []
        for every in batch.column("spans").to_pylist():
            done: list[dict[str, int]] = []
            for s in sorted(every, key=lambda s: (s["start"], s["end"])):
                if done and s["start"] <= done[-1]["end"]:
                    done[-1]["end"] = max(done[-1]["end"], s["end"])
                else:
                    done.append(s)
            where.append(done)
        items = [sorted(set(x)) for x in batch.column("items").to_pylist()]
        out = batch.set_column(batch.schema.get_field_index("items"), "items", pa.array(items, pa.list_(pa.string())))
        yield out.set_column(out.schema.get_field_index("spans"), "spans", pa.array(where, _SPAN_LIST))


def remove_documents(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any hit; columns, whatever their names, are as before.

    A document with a null or empty text stays. One pass per block of items,
    each over what the one before has written.
    """
    spark = session_of(docs)
    ready(spark)
    scratch = Scratch(spark)
    at = docs.columns.index(text_col)
    out, kept = docs, []
    for k, block in enumerate(_blocks(items, item_col, item_text_col, n, block_bytes)):
        if k:
            out = scratch.keep(out, "clean")
            for before in kept:
                scratch.drop(before)
            kept = [out]
        out = out.mapInArrow(_keeper(spark.sparkContext.broadcast(block), at), docs.schema)
    return out


def _keeper(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        known = shared.value
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for w in W.words(batch.column(at), W.ALNUM, fold=True):
                for d in known.hits(w):
                    clean[w.doc + d] = False
            yield batch.filter(pa.array(clean))

    return run


def remove_spans(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents with hit words cut from their texts; columns as before.

    From the first byte of a hit span's first word to the last byte of its
    last word goes; all else, case and spacing included, stays. Null stays
    null. Windows are judged on the input, not on what is left.
    """
    spark = session_of(docs)
    ready(spark)
    scratch = Scratch(spark)
    key = F.sha2(F.col(text_col).cast("string"), 256)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    found = materialize(_found(texts, _blocks(items, item_col, item_text_col, n, block_bytes), scratch), "hits")
    scratch.drop()
    at = docs.columns.index(text_col)
    name, cut = unused(docs, "hit_key"), unused(docs, "hit_spans")
    joined = docs.join(found.select(F.col("key").alias(name), F.col("spans").alias(cut)), key == F.col(name), "left").drop(name)
    return joined.mapInArrow(_cutter(at, len(docs.columns)), docs.schema)


def _cutter(at: int, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        for batch in batches:
            hit = batch.column(columns)
            batch = batch.select(list(range(columns)))
            cut: dict[int, str] = {}
            if hit.null_count < len(hit):
                offsets, data = W.string_buffers(batch.column(at))
                for w in W.words(batch.column(at), W.ALNUM, fold=True, hashed=False):
                    base = offsets[w.doc]
                    for d in range(len(w)):
                        row, first = w.doc + d, w.first[d]
                        if not hit[row].is_valid:
                            continue
                        pieces, last = [], offsets[row]
                        for s in hit[row].as_py():
                            pieces.append(data[last : base + w.start[first + s["start"]]].tobytes())
                            last = base + w.end[first + s["end"] - 1]
                        pieces.append(data[last : offsets[row + 1]].tobytes())
                        cut[row] = b"".join(pieces).decode()
            if cut:
                texts = batch.column(at).to_pylist()
                for row, text in cut.items():
                    texts[row] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    return run
