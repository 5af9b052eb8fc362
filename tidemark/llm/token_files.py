"""Token ids in Parquet files: list columns with controlled pages and row groups.

A file holds one row a document in ascending id order: the id, the token ids as
a list, and small columns (token count, checksum) that can be read without the
ids. Token values are dictionary-coded, counts and ids are delta-coded (Parquet
format v2); every column has page indexes, so a reader that asks for a range of
ids skips the other pages of the long column.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words as W
from ._shared import arrow_rows, materialize, ready, scratch_path, session_of

TOKENIZER = "byte_bpe_50k.json"
#: Appended to every document.
END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Bytes of stored text of a file, when documents are dealt out by id: several row groups. Where
#: that makes fewer files than two for each of the cluster's cores, files are smaller, down to the least.
SHARE_BYTES, LEAST_BYTES = 512 << 20, 1 << 20
#: Documents that a worker gets at once.
BATCH_ROWS = 2000
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 1_000_000

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


_SPACE, _LINE, _MARK, _PLAIN = 1, 2, 3, 4
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x20], _KIND[0x0A] = _SPACE, _LINE
for _lo, _hi in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
    _KIND[_lo : _hi + 1] = _MARK
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _KIND[_lo : _hi + 1] = _PLAIN
#: First bytes of two-byte characters that all are letters (Latin and Cyrillic blocks), but for two of 0xC3.
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xD0, 0xD1]] = True


def pieces(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each piece of the texts, whether a text has a double space).

    A piece starts with a text; at a space, unless it follows a no-break space;
    at an ASCII mark that follows a letter or digit known to be one, or a
    single line's end after an ASCII character that is no space; and at a
    line's end that follows a mark.
    """
    kind = _KIND[data]
    before = np.empty_like(kind)
    before[1:], before[:1] = kind[:-1], 0
    head = at[:-1][at[:-1] < at[1:]]
    before[head] = 0
    twice = (kind == _SPACE) & (before == _SPACE)
    # Both judge a byte by those ahead of it, and hold for the byte behind it.
    closes = (kind == _PLAIN) | ((kind == _LINE) & ((before == _PLAIN) | (before == _MARK)))
    closes[1:] |= _LETTERS[data[:-1]] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    bound = np.zeros(len(data), dtype=bool)
    bound[2:] = (data[1:-1] == 0xA0) & (data[:-2] == 0xC2)
    begin = (kind == _SPACE) & ~bound
    begin[1:] |= (kind[1:] == _MARK) & closes[:-1]
    begin |= (kind == _LINE) & (before == _MARK)
    begin[head] = True
    doubled = np.zeros(len(at) - 1, dtype=bool)
    if twice.any():
        doubled[np.searchsorted(at, np.flatnonzero(twice), side="right") - 1] = True
    return np.flatnonzero(begin), doubled


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n values: at least twice as much where it has to grow."""
    if len(array) >= n:
        return array
    wide = np.empty(max(n, 2 * len(array)), dtype=array.dtype)
    wide[: len(array)] = array
    return wide


class _Known:
    """Remembered pieces and their ids in flat arrays, found by hash for a whole slice at once and compared byte by byte."""

    def __init__(self):
        self.n, self.slot = 0, np.full(1 << 13, -1, dtype=np.int32)
        self.hash, self.uses = np.zeros(1 << 12, dtype=np.uint64), np.zeros(1 << 12, dtype=np.int32)
        # Where the ids and the bytes of each piece begin; one more at the end.
        self.at, self.byte_at = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.ids, self.bytes = np.zeros(1 << 14, dtype=np.int32), np.zeros(1 << 15, dtype=np.uint8)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Number of the piece of each hash, -1 where there is none."""
        found, left = np.full(len(value), -1, dtype=np.int64), np.arange(len(value))
        place = (value & np.uint64(len(self.slot) - 1)).astype(np.int64)
        while len(left):
            number = self.slot[place]
            taken = number >= 0
            hit = taken & (self.hash[number] == value[left])
            found[left[hit]] = number[hit]
            on = taken & ~hit
            left, place = left[on], (place[on] + 1) & (len(self.slot) - 1)
        return found

    def _settle(self, first: int) -> None:
        """Give the pieces from this number on a slot each, the next free one from where their hash points."""
        if len(self.slot) < 2 * self.n:
            self.slot, first = np.full(1 << (4 * self.n).bit_length(), -1, dtype=np.int32), 0
        left = np.arange(first, self.n)
        place = (self.hash[left] & np.uint64(len(self.slot) - 1)).astype(np.int64)
        while len(left):
            free = self.slot[place] < 0
            self.slot[place[free]] = left[free]
            on = self.slot[place] != left
            left, place = left[on], (place[on] + 1) & (len(self.slot) - 1)

    def add(self, hashes: np.ndarray, spelled: list[bytes], found: list[list[int]]) -> None:
        """Pieces of different hashes, none of which is known."""
        n, m = self.n, self.n + len(spelled)
        self.hash, self.uses, self.at, self.byte_at = _grown(self.hash, m), _grown(self.uses, m), _grown(self.at, m + 1), _grown(self.byte_at, m + 1)
        self.hash[n:m], self.uses[n:m] = hashes, 0
        for at, lengths in ((self.at, map(len, found)), (self.byte_at, map(len, spelled))):
            at[n + 1 : m + 1] = at[n] + np.cumsum(np.fromiter(lengths, dtype=np.int64, count=len(spelled)))
        self.ids, self.bytes = _grown(self.ids, int(self.at[m])), _grown(self.bytes, int(self.byte_at[m]))
        self.ids[self.at[n] : self.at[m]] = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(self.at[m] - self.at[n]))
        self.bytes[self.byte_at[n] : self.byte_at[m]] = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.n = m
        self._settle(n)

    def forget_rare(self, most: int) -> None:
        """Keep what was met again, so many of the most used at most."""
        uses = self.uses[: self.n]
        order = np.argsort(-uses, kind="stable")[:most]
        keep = np.sort(order[uses[order] > 1])
        for at, values in (("at", "ids"), ("byte_at", "bytes")):
            whole, begin = getattr(self, at), getattr(self, at)[keep]
            size = whole[keep + 1] - begin
            ends = np.cumsum(size)
            setattr(self, values, getattr(self, values)[_ranges(begin, size)] if len(keep) else getattr(self, values)[:1])
            setattr(self, at, np.concatenate(([0], ends)).astype(np.int64))
        self.hash, self.uses, self.n = self.hash[keep] if len(keep) else self.hash[:1], self.uses[keep] // 2 if len(keep) else self.uses[:1], len(keep)
        self.slot[:] = -1
        self._settle(0)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one range behind the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """The tokenizer's ids of whole texts, by way of remembered pieces.

    The byte-level tokenizer never joins a token over a single space that
    follows another character than a no-break space, from a letter or digit to
    an ASCII mark, or from a mark to a line's end; it does join other marks
    (dashes, ellipses, signs) with ASCII ones. So a text without double spaces
    is the sum of its pieces cut at these places, and pieces repeat. Other
    texts are encoded whole. Every id comes from the tokenizer itself.

    With ``added_tokens`` the tokenizer is used as it comes: the name of an
    added token in a text is that token, and a text that holds one is encoded
    whole. Without, such a name is ordinary text.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        # A worker is one of several on its machine: threads of its own would only cost memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        # A byte-level model spells each byte as one printable character.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.names = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
        self.known = _Known()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _ids_of(self, pieces: list[str]) -> list[list[int]]:
        """Ids of new pieces. A word, with a space before it or not, is one unit to the
        tokenizer's model and goes to it directly; other pieces take the whole way."""
        tokenize, name = self.tokenizer.model.tokenize, self.names
        space = chr(name[0x20])
        found: list = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            if (piece[1:] if piece[0] == " " else piece).isalpha():
                # ASCII letters are spelled as they are.
                spelled = piece.replace(" ", space) if piece.isascii() else piece.encode().decode("latin-1").translate(name)
                found[i] = [t.id for t in tokenize(spelled)]
            else:
                rest.append(i)
        for i, ids in zip(rest, self._whole([pieces[i] for i in rest]), strict=True):
            found[i] = ids
        return found

    def _numbers(self, start: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each piece, and the places of pieces that aren't, by their bytes, what their hash says."""
        known, size = self.known, np.diff(start, append=len(data))
        value = W.spans(data, start, start + size)
        numbers = known.find(value)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            first = new[np.sort(np.unique(value[new], return_index=True)[1])]
            raw = data.tobytes()
            spelled = [raw[s : s + n] for s, n in zip(start[first].tolist(), size[first].tolist(), strict=True)]
            known.add(value[first], spelled, self._ids_of([p.decode() for p in spelled]))
            numbers[new] = known.find(value[new])
        known.uses[numbers] += 1
        begin = known.byte_at[numbers]
        if not np.array_equal(known.byte_at[numbers + 1] - begin, size) or not np.array_equal(known.bytes[_ranges(begin, size)], data[start[0] :]):
            same = [self._same(n, data[s : s + m]) for n, s, m in zip(numbers.tolist(), start.tolist(), size.tolist(), strict=True)]
            return numbers, start[~np.array(same)]
        return numbers, start[:0]

    def _same(self, number: int, piece: np.ndarray) -> bool:
        return np.array_equal(self.known.bytes[self.known.byte_at[number] : self.known.byte_at[number + 1]], piece)

    def _mark_added(self, at: np.ndarray, data: np.ndarray, odd: np.ndarray) -> None:
        """Set ``odd`` for texts that hold an added token's name."""
        raw = data.tobytes() if self.added else b""
        for name in self.added:
            k = raw.find(name)
            while k >= 0:
                odd[np.searchsorted(at, k, side="right") - 1] = True
                k = raw.find(name, k + 1)

    def encode(self, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with END_ID; number of ids of each text)."""
        known = self.known
        if known.n > REMEMBERED:
            known.forget_rare(REMEMBERED // 2)
        n = len(at) - 1
        start, doubled = pieces(at, data)
        flat, wrong = self._numbers(start, data) if len(start) else (np.zeros(0, dtype=np.int64), start)
        # A text with a piece of another's hash goes the whole way too.
        doubled[np.searchsorted(at, wrong, side="right") - 1] = True
        begin = known.at[flat]
        size = known.at[flat + 1] - begin
        ends = np.cumsum(size)
        ids = known.ids[_ranges(begin, size)]
        token_at = np.concatenate(([0], ends))[np.searchsorted(start, at)]
        whole = {}
        self._mark_added(at, data, doubled)
        if doubled.any():
            odd = np.flatnonzero(doubled).tolist()
            whole = dict(zip(odd, self._whole([data[at[t] : at[t + 1]].tobytes().decode() for t in odd]), strict=True))
        out, counts = [], np.zeros(n, dtype=np.int64)
        end = np.array([END_ID], dtype=np.int32)
        for t in range(n):
            own = whole[t] if t in whole else ids[token_at[t] : token_at[t + 1]]
            out += [own, end]
            counts[t] = len(own) + 1
        return (np.concatenate(out) if out else np.zeros(0, dtype=np.int32)), counts


def encoder_of(path: str, added_tokens: bool = False) -> Encoder:
    """This process's encoder: a worker that serves several tasks keeps what it remembers."""
    if (key := f"{path} {added_tokens}") not in W.process_cache:
        W.process_cache[key] = Encoder(path, added_tokens)
    return W.process_cache[key]


def _tokenize(path: str, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, added_tokens)
        for batch in batches:
            for row, at, data in W.slices(batch.column(1), 1 << 20):
                ids, counts = encoder.encode(at, data)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(counts)), pa.array(counts), lists], names=SCHEMA.fieldNames())
        W.make_room(keep=True)

    return run


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, shares: int | None = None, added_tokens: bool = False) -> None:
    """Encode every whole text and write the files in ascending id order.

    Null and empty texts have the end id alone. A null id comes first. Rows
    that share an id follow each other in order of their texts' hashes, then
    texts. Other columns
    are ignored. ``tokenizer`` is a file every executor has. With
    ``added_tokens`` the name of an added token in a text gets that token's id,
    as by an unmodified tokenizer; without, it is ordinary text. An empty table
    makes a table of no rows.
    """
    spark = session_of(docs)
    ready(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if shares is None:
        # The plan knows the size of files; where it doesn't, the texts are measured.
        total = int(str(slim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if total >= 1 << 52:
            total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        shares = max(1, -(-total // SHARE_BYTES), min(-(-total // LEAST_BYTES), 2 * spark.sparkContext.defaultParallelism))
    # The text's hash deals out rows that share an id, or have none.
    order = [F.col("doc_id").asc_nulls_first(), F.col("turn")]
    ordered = slim.withColumn("turn", F.xxhash64("text")).repartitionByRange(int(shares), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    tokens = ordered.mapInArrow(_tokenize(tokenizer or tokenizer_path(), added_tokens), SCHEMA)
    with arrow_rows(spark, BATCH_ROWS):
        tokens.write.options(**{
            "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
            "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "parquet.page.row.count.limit": "1000", "compression": "zstd", "parquet.compression.codec.zstd.level": "1",
        }).parquet(path)


def read(spark: SparkSession, path: str, *, columns: list[str] | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Documents lo <= doc_id < hi of the files, and of them the columns asked for.

    The range is pushed down to row groups and pages; without "ids" among the
    columns the token pages aren't read.
    """
    found = spark.read.schema(SCHEMA).parquet(path)
    if lo is not None:
        found = found.where(F.col("doc_id") >= lo)
    if hi is not None:
        found = found.where(F.col("doc_id") < hi)
    return found.select(*columns) if columns else found


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    W.make_room()
    for batch in batches:
        lists = batch.column(1)
        at = np.asarray(lists.offsets)
        values = np.asarray(lists.values).astype("<u4")
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64()), batch.column(2), batch.column(3)], names=["doc_id", "n_tokens", "ids_crc32", "file", "row"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    start counts the ids of all documents before it: sums of whole files are
    added up in file order, those of documents within a file in row order.
    """
    ready(spark)
    raw = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "ids", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file"), F.col("_metadata.row_index").alias("row"))
    sums = raw.mapInArrow(_checksums, "doc_id long, n_tokens long, ids_crc32 long, file int, row long")
    with arrow_rows(spark, BATCH_ROWS):
        slim = materialize(sums, "checksums")
    files = slim.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    # Spark's writer names its files by partition, and partitions are in id order.
    ahead = files.withColumn("ahead", F.coalesce(F.sum("held").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "ahead")
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(ahead, "file")
    return placed.select("doc_id", (F.col("ahead") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def encode(docs: DataFrame, **options) -> DataFrame:
    """Write the files to the shared folder, read them back, and give their digest."""
    spark = session_of(docs)
    path = scratch_path(spark, "tokens")
    write(docs, path, **options)
    return digest(spark, path)


