"""Quality scores by nearest-neighbour voting in a latent space.

Whole texts become tf-idf weights of hashed words and character trigrams, of
bytes and trigrams of character classes, and a few shapes of words; a truncated
singular value decomposition of a bounded labelled sample gives the latent
space. The sample's vectors are broadcast; every document's exact cosines with
all of them are computed in blocks, and the nearest vote with their similarity
as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._shared import ready, session_of

#: Hashed features of each kind: words; character trigrams; bytes and class trigrams. Shapes follow them.
HASHED = 1 << 11
GRAMS = 3 * HASHED
SHAPES = ["words", "same as the word before", "capitals only", "starts with a capital", "has a digit", "ends in a mark", "bare mark", "long", "short", "lines", "no words"]
FEATURES = GRAMS + len(SHAPES)
#: Labelled documents of each class in the sample, at most: what the driver gets and every task holds.
SAMPLE_OF_CLASS = 1500
DIMENSIONS = 48
NEIGHBOURS = 25
#: Similarities are raised to this power before they weigh labels.
SHARPNESS = 8
THRESHOLD = 0.3
#: Weight of words and character trigrams beside bytes, classes and shapes.
WORD_WEIGHT = 0.5
BLOCK = 256

_CLASS = np.zeros(256, dtype=np.uint32)
_CLASS[0x30:0x3A] = 1  # digits
_CLASS[0x41:0x5B] = 2  # capitals
_CLASS[0x61:0x7B] = 3  # small letters
_CLASS[0x80:] = 4
for _c in b" \n\t\r":
    _CLASS[_c] = 5
for _k, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_c] = 6 + _k  # each mark is a class of its own


def _hashed(g: np.ndarray) -> np.ndarray:
    g = g * np.uint32(0x9E3779B1)
    return (g ^ g >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - HASHED.bit_length() + 1)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, weights) of blocks of documents: square roots of relative frequencies. A row's are its text's alone."""
    for w in W.words(column, W.SPACED, fold=False):
        data = w.data
        n = len(data)
        x = _CLASS[data]
        byte = data.astype(np.uint32)
        edges = _edges(column, w)
        head_at = edges[:-1][edges[:-1] < edges[1:]]
        back = []  # class and byte one and two places before, 0 ahead of a text
        for source in (x, byte):
            one, two = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
            one[1:], two[2:] = source[:-1], source[:-2]
            one[head_at] = two[head_at] = 0
            after = head_at + 1
            two[after[after < n]] = 0
            back.append((one, two))
        (c1, c2), (b1, b2) = back
        # Trigrams of characters; single bytes; trigrams of classes.
        grams = [(HASHED, _hashed(byte | b1 << np.uint32(8) | b2 << np.uint32(16) | np.uint32(1 << 24))), (2 * HASHED, _hashed(byte | np.uint32(1 << 8))), (2 * HASHED, _hashed(x | c1 << np.uint32(6) | c2 << np.uint32(12) | np.uint32(1 << 20)))]
        spelt = (w.value >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64)
        size = w.end - w.start
        head, tail = x[w.start], x[w.end - 1]
        again = np.zeros(len(size), dtype=bool)
        again[1:] = w.value[1:] == w.value[:-1]
        again[w.first[:-1][w.first[:-1] < len(size)]] = False
        lower = np.concatenate(([0], np.cumsum(x == 3)))
        upper = np.concatenate(([0], np.cumsum(x == 2)))
        digit = np.concatenate(([0], np.cumsum(x == 1)))
        capital = (upper[w.end] - upper[w.start] > 1) & (lower[w.end] == lower[w.start])
        letters = x[w.start] >= 6
        flags = [np.ones(len(size), bool), again, capital, head == 2, digit[w.end] > digit[w.start], tail >= 6, letters & (size <= 3) & (tail >= 6), size > 15, size <= 2]
        totals = [np.concatenate(([0], np.cumsum(f))) for f in flags]
        lines = np.concatenate(([0], np.cumsum(data == 0x0A)))
        for lo in range(0, len(w), BLOCK):
            hi = min(lo + BLOCK, len(w))
            rows, at = hi - lo, edges[lo : hi + 1]
            first = w.first[lo : hi + 1]
            count = np.diff(first)
            out = np.zeros((rows, FEATURES), dtype=np.float32)
            doc = np.repeat(np.arange(rows), np.diff(at))
            length = np.maximum(np.diff(at), 1)[:, None]
            for place, g in grams:
                out[:, place : place + HASHED] += np.bincount(doc * HASHED + g[at[0] : at[-1]], minlength=rows * HASHED).reshape(rows, HASHED) / length
            of_words = np.repeat(np.arange(rows), count) * HASHED + spelt[first[0] : first[-1]]
            out[:, :HASHED] = np.bincount(of_words, minlength=rows * HASHED).reshape(rows, HASHED) / np.maximum(count, 1)[:, None]
            for k, t in enumerate(totals):
                out[:, GRAMS + k] = np.diff(t[first]) / np.maximum(count, 1)
            out[:, GRAMS + 9] = np.minimum(np.diff(lines[at]) / np.maximum(count, 1), 1)
            out[:, GRAMS + 10] = count == 0
            np.sqrt(out, out=out)
            yield w.doc + lo, out


def _edges(column: pa.Array, w: W.Words) -> np.ndarray:
    at, _ = W.string_buffers(column)
    return at[w.doc : w.doc + len(w) + 1] - at[w.doc]


@dataclass
class Model:
    scale: np.ndarray  # weight of each feature
    basis: np.ndarray  # (features, dimensions)
    vectors: np.ndarray  # unit vectors of the labelled sample
    labels: np.ndarray
    weight: np.ndarray  # of each labelled vector's vote
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        y = (x * self.scale) @ self.basis
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cosine = self.project(x) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0.0).astype(np.float64) ** SHARPNESS * self.weight[near]
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1)
        return np.where(total > 1e-12, vote / np.maximum(total, 1e-12), self.prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_SPARSE = "label int, feature array<int>, value array<float>"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    W.make_room()
    for batch in batches:
        for row, x in features(batch.column(1)):
            at, feature = np.nonzero(x)
            ends = pa.array(np.searchsorted(at, np.arange(len(x) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (feature.astype(np.int32), x[at, feature])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), *lists], names=["label", "feature", "value"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_OF_CLASS, dimensions: int = DIMENSIONS) -> Model:
    """Learn from labelled documents; hashes of their ids choose ``per_class`` of each class at most.

    Labels are 0 and 1; other values, and rows with a null id, text or label,
    are skipped. A document with several labels has the smallest. A sample
    holds the classes in other shares than the labels do, so votes are weighed
    back. Without any label every document scores 0.5.
    """
    spark = session_of(docs)
    ready(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), 0.5)
    prior = counts.get(1, 0) / sum(counts.values())
    shares = F.create_map(*(F.lit(v) for label, n in sorted(counts.items()) for v in (label, min(1.0, 1.5 * per_class / n))))
    draw = F.pmod(F.xxhash64(F.lit(7), F.col("id").cast("string")), F.lit(1 << 40))
    # A few thousand ids, by the draw; the order then bounds the sample exactly.
    chosen = known.withColumn("draw", draw).where(F.col("draw") / F.lit(float(1 << 40)) < shares[F.col("label")])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "id")
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "id", F.xxhash64("text")))
    got = texts.withColumn("place", place).where(F.col("place") <= per_class).select("label", "text").mapInArrow(_vectors, _SPARSE).toArrow().combine_chunks()
    y = np.asarray(got["label"]).astype(np.float64)
    lists = got["feature"].combine_chunks()
    size, feature, value = np.diff(np.asarray(lists.offsets)), np.asarray(lists.flatten()), np.asarray(got["value"].combine_chunks().flatten())
    row = np.repeat(np.arange(len(y)), size)
    # Reruns agree, whatever the rows' order. The driver holds the sample once, dense, beside these.
    order = np.lexsort((np.bincount(row, value * (feature + 1.0), minlength=len(y)), y))
    place = np.empty(len(y), dtype=np.int64)
    place[order] = np.arange(len(y))
    x = np.zeros((len(y), FEATURES), dtype=np.float32)
    x[place[row], feature] = value
    return learn(x, y[order], prior, dimensions)


def learn(x: np.ndarray, y: np.ndarray, prior: float, dimensions: int) -> Model:
    """The model of labelled vectors, which are scaled in place. A vote counts as its class is common among all labels, against the sample."""
    if not len(x):
        return Model(np.ones(FEATURES, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior)
    found = np.concatenate([np.count_nonzero(x[:, k : k + 512], axis=0) for k in range(0, x.shape[1], 512)])
    scale = (np.log((1 + len(x)) / (1 + found)) + 0.3).astype(np.float32)
    scale[:HASHED] *= WORD_WEIGHT
    scale[HASHED : 2 * HASHED] *= WORD_WEIGHT
    scale[GRAMS:] = 1.5
    a = x
    a *= scale
    rng = np.random.default_rng(3)
    rank = min(dimensions, *a.shape)
    q = np.linalg.qr(a.T @ (a @ rng.standard_normal((a.shape[1], min(rank + 16, min(a.shape)))).astype(np.float32)))[0]
    for _ in range(3):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    _, _, v = np.linalg.svd(a @ q, full_matrices=False)
    basis = (q @ v.T)[:, :rank].astype(np.float32)
    share = float(y.mean())
    weight = np.where(y > 0, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    model = Model(scale, basis, np.zeros((0, rank), np.float32), y, weight, prior)
    latent = a @ basis
    model.vectors = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **options) -> Model:
    """Learn from labels of documents that aren't held out."""
    return fit(docs, labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))), id_col=id_col, **options)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher is better) of every document, from its whole text alone.

    A null text scores as an empty one. Repeated rows each get their row, and
    equal texts equal scores (to rounding), whatever rows are near them; of
    labelled texts that tie for the last place among the nearest any may vote. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = session_of(docs)
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, x in features(batch.column(1)):
                out[row : row + len(x)] = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(out, 0.0, 1.0))], names=["id", "score"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
