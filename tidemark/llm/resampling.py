"""Importance resampling of documents towards a target text distribution.

Features are runs of one to three words, counted in hashed buckets. Every
bucket's gain is the logarithm of its share of the target over its share of the
corpus; a document's weight is the sum of its features' gains, and documents
are drawn without replacement by adding Gumbel noise and keeping the highest.

Within a task the words of a block of texts become ids, and the positions of
the block are ordered by what follows them: a suffix array of word ids, to the
depth of the longest feature. Where neighbours in that order share their first
n ids they are one run of the same n-gram: its bytes are hashed once, from the
checksums of its words, and the bucket goes back to every position of the run.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._shared import Scratch, ready, session_of, unused

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 3
#: Documents with fewer words are scored, but not drawn.
LEAST_WORDS = 20
#: Hundredths of the documents with enough words that are drawn.
PERCENT = 5
SEED = 42
#: Bytes of text whose words are ordered together, and word positions of one order (an id has 21 bits of a key).
BLOCK_BYTES, BLOCK_WORDS = 1 << 20, (1 << 20) - LONGEST
#: Documents that one task ranks, on average.
RANK_ROWS = 20_000

_ID = 21
_MASK = (1 << _ID) - 1
_SPACE = zlib.crc32(b" ")


def _byte_table() -> np.ndarray:
    """Remainders of CRC-32, reflected, by the rule: eight bits of division a byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_TABLE = _byte_table()


def _followed(c: np.ndarray) -> np.ndarray:
    """Checksums as one more zero byte would leave them, without the start and end values."""
    return _TABLE[c & 255] ^ (c >> np.uint32(8))


def _by_powers() -> np.ndarray:
    """[j, byte place, byte]: what 2**j bytes that follow make of a checksum's byte; the map is linear, so bytes add up by xor."""
    first = np.stack([_followed(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])
    powers = [first]
    for _ in range(30):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(powers)


def _apply(power: np.ndarray, c: np.ndarray) -> np.ndarray:
    return power[0][c & 255] ^ power[1][c >> np.uint32(8) & np.uint32(255)] ^ power[2][c >> np.uint32(16) & np.uint32(255)] ^ power[3][c >> np.uint32(24)]


_POWERS = _by_powers()
#: The same for each number of bytes under 64, which nearly all words have.
SHORT = 64


def _by_length() -> np.ndarray:
    made = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(SHORT - 1):
        made.append(_followed(made[-1]))
    return np.stack(made).reshape(-1)


_LENGTHS = _by_length()


def _shifted(c: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part that text with checksum ``c`` has in that of the same text followed by ``by`` bytes."""
    at = np.minimum(by, SHORT - 1) * 1024
    out = _LENGTHS[at + (c & 255)] ^ _LENGTHS[at + 256 + (c >> np.uint32(8) & np.uint32(255))] ^ _LENGTHS[at + 512 + (c >> np.uint32(16) & np.uint32(255))] ^ _LENGTHS[at + 768 + (c >> np.uint32(24))]
    for i in np.flatnonzero(by >= SHORT):
        one = c[i : i + 1]
        for j in range(int(by[i]).bit_length()):
            if int(by[i]) >> j & 1:
                one = _apply(_POWERS[j], one)
        out[i] = one[0]
    return out


def _word_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    short = np.flatnonzero(size < SHORT)
    for k in range(int(size[short].max(initial=0))):
        short = short[size[short] > k]
        out[short] = _TABLE[(out[short] ^ data[start[short] + k]) & np.uint32(255)] ^ (out[short] >> np.uint32(8))
    out = ~out
    for i in np.flatnonzero(size >= SHORT):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def buckets(w: W.Words, lo: int, hi: int, doc: np.ndarray, n_buckets: int) -> np.ndarray:
    """[n - 1, position]: the bucket of the n-gram that starts at each word lo..hi-1, or -1 where the document ends before.

    ``doc`` has each word's document.
    """
    m, top = hi - lo, min(hi + LONGEST - 1, len(w.value))
    ids = np.asarray(pa.array(w.value[lo:top]).dictionary_encode().indices).astype(np.int64)
    # Ids are given in order of first occurrence.
    first = np.flatnonzero(np.diff(np.maximum.accumulate(ids), prepend=-1) > 0) + lo
    size = w.end[first] - w.start[first]
    sums = _word_sums(w.data, w.start[first], w.end[first])
    spaced = _shifted(np.full(len(first), _SPACE, dtype=np.uint32), size) ^ sums
    pad = np.zeros(LONGEST, dtype=np.int64)
    after = np.concatenate([ids + 1, pad])  # 0: nothing follows
    home = np.concatenate([doc[lo:top], pad - 1])
    key = after[:m].copy()
    for k in range(1, LONGEST):
        key = key << _ID | np.where(home[k : m + k] == home[:m], after[k : m + k], 0)
    order = np.argsort(key)
    key = key[order]
    out = np.full((LONGEST, m), -1, dtype=np.int32)
    for n in range(1, LONGEST + 1):
        common = key >> _ID * (LONGEST - n)
        heads = np.flatnonzero(np.diff(common, prepend=-1))
        full = common[heads] & _MASK != 0
        at = order[heads][full]
        c = sums[ids[at]]
        for k in range(1, n):
            word = ids[at + k]
            c = _shifted(c, size[word] + 1) ^ spaced[word]
        run = np.full(len(heads), -1, dtype=np.int32)
        run[full] = (c % np.uint32(n_buckets)).astype(np.int32)
        out[n - 1, order] = np.repeat(run, np.diff(heads, append=m))
    return out


def _blocks(column: pa.Array, n_buckets: int) -> Iterator[tuple[W.Words, int, int, np.ndarray]]:
    """(words, first position, position past the last, buckets)."""
    for w in W.words(column, W.ALNUM, fold=True, size=BLOCK_BYTES):
        doc = np.repeat(np.arange(len(w)), np.diff(w.first))
        for lo in range(0, len(doc), BLOCK_WORDS):
            hi = min(lo + BLOCK_WORDS, len(doc))
            yield w, lo, hi, buckets(w, lo, hi, doc, n_buckets)


def _counter(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        seen = np.zeros(n_buckets + 1, dtype=np.int64)
        for batch in batches:
            for _, _, _, b in _blocks(batch.column(0), n_buckets):
                seen += np.bincount(b.ravel() + 1, minlength=n_buckets + 1)
        full = np.flatnonzero(seen[1:])
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(seen[1:][full])], names=["bucket", "seen"])
        W.make_room()

    return run


def bucket_counts(docs: DataFrame, *, text_col: str = "text", n_buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; a task sends one row a bucket at most."""
    ready(session_of(docs))
    seen = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counter(n_buckets), "bucket int, seen long")
    seen = seen.groupBy("bucket").agg(F.sum("seen").alias("seen")).toArrow()
    counts = np.zeros(n_buckets, dtype=np.int64)
    counts[np.asarray(seen["bucket"])] = np.asarray(seen["seen"])
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, thousandths of the logarithm of its share of the target over that of the corpus, each count plus one."""
    n, every, wanted = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (every + n)) / float((s + 1) * (wanted + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _scorer(gain_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        gain = np.append(gain_of.value, 0)  # bucket -1
        for batch in batches:
            rows = batch.num_rows
            n_words, weight = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
            for w, lo, hi, b in _blocks(batch.column(1), len(gain) - 1):
                ahead = np.concatenate([[0], np.cumsum(gain[b].sum(0))])
                cut = np.clip(w.first, lo, hi) - lo
                n_words[w.doc : w.doc + len(w)] += np.diff(cut)
                weight[w.doc : w.doc + len(w)] += np.diff(ahead[cut])
            features = sum(np.maximum(n_words - k, 0) for k in range(LONGEST))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])
        W.make_room()

    return run


def score(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score: the weight with the noise that the id and seed give."""
    spark = session_of(docs)
    ready(spark)
    held = spark.sparkContext.broadcast(gain)  # one number a bucket
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    scored = slim.mapInArrow(_scorer(held), "doc_id long, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    even = (F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return scored.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(even))))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, n_buckets: int = BUCKETS, seed: int = SEED, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Every document's weight and score, and the rank of those drawn.

    A-Z are lower-cased; words are runs of ASCII digits, letters and whatever is
    not ASCII. Of the N documents with at least ``least_words`` words the
    floor(percent * N / 100) highest scores are drawn, ties to the smaller id
    (null last). Returns doc_id, n_words, n_features, weight, score, rank (1,
    2, 3...; null if not drawn).

    A null text, or one without words, has no features and weight 0. Rows that
    share an id share their noise; repeated rows are documents of their own,
    and which of them gets which rank is open. Other columns are ignored. An
    empty target gives every bucket the same share; an empty table gives an
    empty result.
    """
    spark = session_of(docs)
    scratch = Scratch(spark)
    gain = gains(bucket_counts(docs, text_col=text_col, n_buckets=n_buckets), bucket_counts(target, text_col=target_text_col, n_buckets=n_buckets))
    scored = score(docs, gain, id_col=id_col, text_col=text_col, seed=seed)
    # A number of its own tells rows apart that tie in all else, so that any number of them is dealt out.
    scored = scratch.keep(scored.withColumn("row", F.monotonically_increasing_id()), "scores", compression="zstd")
    long = scored.where(F.col("n_words") >= least_words)
    n = long.count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranges = long.repartitionByRange(max(1, -(-n // rank_rows)), *order).withColumn("range", F.spark_partition_id())
    ranges = scratch.keep(ranges, "ranges", compression="zstd")
    # One row a range: how many stand before it.
    held = ranges.groupBy("range").agg(F.count("*").alias("held"))
    ahead = held.select("range", F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    place = (F.col("ahead") + F.col("inside")).cast("long")
    ranked = ranges.withColumn("inside", inside).join(ahead, "range").withColumn("rank", F.when(place <= percent * n // 100, place))
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionAll(short.select(*names))


def draw(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, columns as before; rows that share a drawn id all come, rows without an id never."""
    name = unused(docs, "drawn")
    drawn = resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drawn, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_semi")
