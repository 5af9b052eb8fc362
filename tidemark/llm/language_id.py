"""Language identification by hierarchical discrimination.

First one-versus-rest linear models choose the language's family; then
one-versus-one linear support vector machines separate the languages within it,
and their votes choose. Features are hashed character n-grams of the whole text.
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

UNDETERMINED = "und"
#: Hashed features of character 1- to 3-grams.
FEATURES = 1 << 12
#: Training texts of a language, and of all, at most: bounds what the driver gets.
SAMPLE_OF_LANGUAGE = 400
SAMPLE = 8000
#: Documents below this score are rejected where language ID filters.
MIN_SCORE = 0.5

#: Families of language codes. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "semitic": ["am", "ar", "he", "mt"],
    "celtic": ["br", "cy", "ga", "gd"],
    "austronesian": ["id", "jv", "ms", "su", "tl"],
    "dravidian": ["kn", "ml", "ta", "te"],
}

_U = np.uint64


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, members in FAMILIES.items() if code in members), lang)


_SPACE = np.full(256, 0x20, dtype=np.uint8)
_SPACE[0x61:0x7B] = np.arange(0x61, 0x7B)
_SPACE[0x80:] = np.arange(0x80, 0x100)


def _folded(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(column.cast(pa.string()))


def _grams(at: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Feature of the 1-, 2- and 3-gram that ends at each byte; letters only, others are one space."""
    x = _SPACE[data].astype(np.uint32)
    before = np.empty_like(x)
    before[1:], before[:1] = x[:-1], 0x20
    two = np.empty_like(x)
    two[2:], two[:2] = x[:-2], 0x20
    begin = at[:-1][at[:-1] < at[1:]]
    before[begin] = two[begin] = 0x20
    nxt = begin + 1
    two[nxt[nxt < len(x)]] = 0x20
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    out = [x * np.uint32(0x85EBCA6B), (x | before << np.uint32(8) | np.uint32(1 << 16)) * np.uint32(0x9E3779B1), (x | before << np.uint32(8) | two << np.uint32(16) | np.uint32(1 << 24)) * np.uint32(0xC2B2AE35)]
    return [(g ^ g >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> shift for g in out]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    W.make_room()
    for batch in batches:
        folded = _folded(batch.column(1))
        for row, at, data in W.slices(folded):
            index, value = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                found = np.bincount(np.concatenate(_grams(np.array([0, b - a]), data[a:b])), minlength=FEATURES) if b > a else np.zeros(FEATURES)
                full = np.flatnonzero(found)
                index.append(full.astype(np.int32))
                value.append((found[full] / max(1, 3 * (b - a))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(index)), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["lang", "feature", "value"])


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, c: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge) by dual coordinate descent; y is +1 or -1."""
    rng = np.random.default_rng(5)
    n = len(y)
    own = c * n / (2 * np.where(y > 0, max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))))
    norms = np.einsum("ij,ij->i", x, x) + 1 + 0.5 / own
    alpha, w, b = np.zeros(n), np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        for i in rng.permutation(n):
            g = y[i] * (x[i] @ w + b) - 1 + alpha[i] * 0.5 / own[i]
            new = max(alpha[i] - g / norms[i], 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w += step * x[i]
                b += step
                alpha[i] = new
    return w, b


@dataclass
class Model:
    families: list[list[str]]
    weights: np.ndarray  # (machines, features): families first, then pairs
    bias: np.ndarray
    pairs: list[tuple[int, int, int]]  # (family, language, language) of each later machine

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, f = len(margins), len(self.families)
        sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        if f > 1:
            odds = sure(margins[:, :f])
            # Against the next family alone: a score doesn't fall with the number of families.
            family, two = margins[:, :f].argmax(1), np.partition(odds, f - 2, axis=1)[:, f - 2 :]
            trust = two[:, 1] / np.maximum(two.sum(1), 1e-12)
        else:
            family, trust = np.zeros(n, dtype=int), np.ones(n)
        offset = f if f > 1 else 0
        names, score = [], np.zeros(n)
        votes = [np.zeros((n, len(x))) for x in self.families]
        firm = [np.zeros((n, len(x))) for x in self.families]
        for k, (g, a, b) in enumerate(self.pairs):
            p = sure(margins[:, offset + k])
            votes[g][:, a] += p >= 0.5
            votes[g][:, b] += p < 0.5
            firm[g][:, a] += p
            firm[g][:, b] += 1 - p
        for i, g in enumerate(family.tolist()):
            rank = votes[g][i] + firm[g][i] / (len(self.families[g]) + 1)
            best = int(rank.argmax())
            names.append(self.families[g][best])
            rivals = len(self.families[g]) - 1
            score[i] = trust[i] * (firm[g][i][best] / rivals if rivals else 1.0)
        return names, np.clip(score, 0.0, 1.0)


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_OF_LANGUAGE, most: int = SAMPLE) -> Model:
    """Learn from rows with a text and a language.

    Hashes of id and text choose ``per_language`` texts of each language, and
    ``most`` in all, at most; rows are counted in full, but no more come to the
    driver, where each is its counts of features. Rows with a null id, text or
    language are skipped; equal rows are alike to the choice. Without any row
    the model knows no language and every document is undetermined.
    """
    spark = session_of(labelled)
    ready(spark)
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, FEATURES), dtype=np.float32), np.zeros(0), [])
    each = max(1, min(per_language, most // len(counts)))
    # A first draw by hash leaves little to order; the order then bounds the sample exactly.
    shares = F.create_map(*(F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, 1.5 * each / n))))
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(1 << 40))).where(F.col("draw") / F.lit(float(1 << 40)) < shares[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id", F.xxhash64("text")))
    sample = drawn.withColumn("place", place).where(F.col("place") <= each).select("lang", "text")
    got = sample.mapInArrow(_counts, "lang string, feature array<int>, value array<float>").toArrow().combine_chunks()
    langs = np.array(got["lang"].to_pylist(), dtype=object).astype(str)
    x = np.zeros((got.num_rows, FEATURES), dtype=np.float32)
    if got.num_rows:
        feature = got["feature"].combine_chunks()
        x[np.repeat(np.arange(got.num_rows), np.diff(np.asarray(feature.offsets))), np.asarray(feature.flatten())] = np.asarray(got["value"].combine_chunks().flatten())
    del got
    order = np.lexsort((x @ np.arange(1, FEATURES + 1), langs))  # reruns agree, whatever the rows' order
    x, langs = x[order], langs[order]
    np.sqrt(x, out=x)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return _learn(x, langs)


def _learn(x: np.ndarray, langs: np.ndarray) -> Model:
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(langs.tolist())):
        groups.setdefault(family_of(lang), []).append(lang)
    families = [groups[g] for g in sorted(groups)]
    weights, bias, pairs = [], [], []
    if len(families) > 1:
        for members in families:
            w, b = _svm(x, np.where(np.isin(langs, members), 1.0, -1.0))
            weights.append(w)
            bias.append(b)
    for g, members in enumerate(families):
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                part = np.isin(langs, [members[a], members[b]])
                w, o = _svm(x[part], np.where(langs[part] == members[a], 1.0, -1.0))
                weights.append(w)
                bias.append(o)
                pairs.append((g, a, b))
    return Model(families, np.array(weights).reshape(-1, FEATURES), np.array(bias), pairs)


def _features(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Rows of unit length: square roots of gram frequencies."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), at[1:] - at[:-1])
    x = np.zeros((n, FEATURES), dtype=np.float32)
    flat = x.reshape(-1)
    for g in _grams(at, data):
        flat += np.bincount(doc * FEATURES + g, minlength=n * FEATURES).astype(np.float32)
    np.sqrt(x, out=x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def _judge(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of every text of a column."""
    names: list[str] = [UNDETERMINED] * len(column)
    score = np.zeros(len(column))
    if not model.families:
        return names, score
    folded = _folded(column)
    weights = model.weights.T.astype(np.float32)
    for row, at, data in W.slices(folded, 1 << 19):
        letters = np.zeros(len(at) - 1, dtype=bool)
        full = np.flatnonzero(at[:-1] < at[1:])
        if len(full):
            letters[full] = np.bitwise_or.reduceat((data >= 0x61) & (data <= 0x7A), at[:-1][full])
        for d in full[~letters[full]].tolist():  # no ASCII letter: look at characters
            letters[d] = any(c.isalpha() for c in data[at[d] : at[d + 1]].tobytes().decode())
        for lo in range(0, len(at) - 1, 256):
            hi = min(lo + 256, len(at) - 1)
            part = at[lo : hi + 1]
            found, s = model.predict(_features(part - part[0], data[part[0] : part[-1]]) @ weights + model.bias)
            for d in np.flatnonzero(letters[lo:hi]).tolist():
                names[row + lo + d], score[row + lo + d] = found[d], s[d]
    return names, score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every document, from its whole text alone.

    A null text, or one without any letter, is ``und`` with score 0. Of
    families whose machines agree the first is taken; of languages with as many
    votes the one whose machines are surer, then the first. Repeated rows each
    get their row, and equal texts equal answers; other columns are ignored. An
    empty table gives an empty result.
    """
    spark = session_of(docs)
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        for batch in batches:
            names, score = _judge(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Documents with a language, known with min_score at least; columns, whatever their names, are as before.

    Null texts and texts without letters go; repeated rows stay or go together.
    """
    spark = session_of(docs)
    ready(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        for batch in batches:
            names, score = _judge(shared.value, batch.column(at))
            keep = (np.array(names, dtype=object) != UNDETERMINED) & (score >= min_score)
            yield batch.filter(pa.array(keep.astype(bool)))
        W.make_room()

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, *, id_col: str = "doc_id", **options) -> Model:
    """Learn from the rows that aren't held out."""
    known = docs.where(F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2))
    return fit(known, id_col=id_col, **options)
