"""N-gram Jaccard join: which documents share most of their word shingles.

A document's set holds its distinct 5-word shingles. Shingles are ordered
rare-first by a fixed-size sketch of their corpus frequency. Two sets can only
be as alike as asked for if they share a shingle of their prefixes, so prefixes
are dealt out by shingle, and pairs are drawn within a shingle under length,
positional and bitmap (suffix) filters and verified once.

Copies and large groups of near copies never become all their pairs: equal sets
are one class from the start, each shingle's group is first tied to a few
leaders if it is large, and of its pairs only those of classes that are not
connected yet are drawn after that. Every link between unconnected classes is
looked for, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _words as W
from ._shared import Scratch, arrow_rows, materialize, ready, release, session_of, unused
from .components import components

SHINGLE = 5
#: A pair links when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Buckets of the frequency sketch: a fixed size, whatever the corpus.
BUCKETS = 1 << 16
#: Classes that share a prefix shingle, up to which all their pairs are drawn at once.
SMALL = 8
#: Leaders to which a larger group is tied before its pairs are drawn.
LEADERS = 8
#: Times the mean count of a bucket of the sketch from which its shingles are hot, and parts that their groups are dealt into.
HOT, SALTS = 4, 1024
BITS = 16  # words of 64 bits of a set's bitmap
CELLS = 512  # counts of a set's histogram
#: Words of the filter that says which sets a scan must hand out: a fixed size.
FILTER_WORDS = 1 << 17

_U = np.uint64


def _sets(w: W.Words, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle hashes, with repeats) of each document that has words."""
    grams = W.ngrams(w.value, size)
    first = w.first.tolist()
    for d in range(len(w)):
        lo, hi = first[d], first[d + 1]
        if hi - lo >= size:
            yield w.doc + d, grams[lo : hi - size + 1]
        elif hi > lo:
            yield w.doc + d, W.ngrams(w.value[lo:hi], hi - lo)


def _class_of(grams: np.ndarray) -> int:
    """63-bit key of a set: never 0, which stands for the empty set."""
    with np.errstate(over="ignore"):
        total = np.sum(W.mix(grams ^ _U(0x51ED270B7A12F3C5)), dtype=np.uint64) + _U(len(grams))
    return int(W.mix(np.array([total]))[0] >> _U(1)) or 1


def _bitmap(grams: np.ndarray) -> np.ndarray:
    """Parity bits: two sets' bitmaps differ in at most as many bits as the sets do."""
    spot = (grams & _U(BITS * 64 - 1)).astype(np.int64)
    odd = np.bincount(spot, minlength=BITS * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _histogram(grams: np.ndarray) -> bytes:
    """Counts, 255 at most: two sets' counts differ by at most as much as the sets do."""
    return np.minimum(np.bincount((grams >> _U(16) & _U(CELLS - 1)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


_PROFILE = "doc_id long, row long, cls long, n long, bitmap array<long>, cells binary, bucket int, seen long"


def _profiler(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        counts = np.zeros(BUCKETS, dtype=np.int64)
        met: set[int] = set()
        for batch in batches:
            rows = batch.num_rows
            cls, n = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
            bits, cells = np.zeros((rows, BITS), dtype=np.int64), [None] * rows
            for w in W.words(batch.column(2), W.SPACED, fold=True):
                new = []
                for row, grams in _sets(w, size):
                    grams = np.unique(grams)
                    key = _class_of(grams)
                    cls[row], n[row], bits[row], cells[row] = key, len(grams), _bitmap(grams), _histogram(grams)
                    if key not in met:  # copies that this task has met count once
                        met.add(key)
                        new.append(grams)
                if new:
                    counts += np.bincount((np.concatenate(new) >> _U(48)).astype(np.int64), minlength=BUCKETS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BITS + 1, BITS), pa.int32()), pa.array(bits.ravel()))
            none = [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls), pa.array(n), lists, pa.array(cells, pa.binary()), *none], names=_NAMES)
        full = np.flatnonzero(counts)
        if len(full):
            none = [pa.nulls(len(full), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(full.astype(np.int32)), pa.array(counts[full])], names=_NAMES)
        W.make_room()

    return run


_NAMES = ["doc_id", "row", "cls", "n", "bitmap", "cells", "bucket", "seen"]


def _ordered(grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set, rare first: a gram's bucket is replaced by the rank of its frequency."""
    return np.unique((rank[(grams >> _U(48)).astype(np.int64)] << _U(48)) | (grams & _U((1 << 48) - 1)))


def _prefixer(rank_of, size: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        rank = rank_of.value
        met: set[int] = set()
        for batch in batches:
            for w in W.words(batch.column(0), W.SPACED, fold=True):
                token, cls, n, pos = [], [], [], []
                for _, grams in _sets(w, size):
                    key = _class_of(np.unique(grams))
                    if key in met:
                        continue
                    met.add(key)
                    rare = _ordered(grams, rank)
                    count = len(rare)
                    keep = count - -(-similarity * count // 100) + 1
                    token.append(rare[:keep])
                    cls.append(np.full(keep, key))
                    n.append(np.full(keep, count))
                    pos.append(np.arange(keep))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(W.as_long(np.concatenate(token))), *(pa.array(np.concatenate(x).astype(t)) for x, t in ((cls, np.int64), (n, np.int32), (pos, np.int32)))], names=["token", "cls", "n", "pos"])
        met.clear()
        W.make_room()

    return run


def _holder(likely, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        bits = likely.value
        for batch in batches:
            rows = np.asarray(batch.column(0)).view(np.uint64)
            asked = bits[(rows >> _U(6)) % _U(FILTER_WORDS)] >> (rows & _U(63)) & _U(1) == 1
            batch = batch.filter(pa.array(asked))
            for w in W.words(batch.column(1), W.SPACED, fold=True):
                row, cls, sets = [], [], []
                for r, grams in _sets(w, size):
                    grams = np.unique(grams)
                    row.append(r)
                    cls.append(_class_of(grams))
                    sets.append(grams)
                if row:
                    ends = np.cumsum([0, *map(len, sets)])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(W.as_long(np.concatenate(sets))))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(cls, pa.int64()), lists], names=["row", "cls", "grams"])
        W.make_room()

    return run


def _verifier(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.make_room()
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            sides = []
            for k in (2, 3):
                at = np.asarray(batch.column(k).offsets)
                values = np.asarray(batch.column(k).values).view(np.uint64)
                sides.append((at, values))
            (at_a, all_a), (at_b, all_b) = sides
            for i in range(batch.num_rows):
                a, b = all_a[at_a[i] : at_a[i + 1]], all_b[at_b[i] : at_b[i + 1]]
                spot = np.minimum(np.searchsorted(a, b), len(a) - 1)
                both = int(np.count_nonzero(a[spot] == b))
                keep[i] = 100 * both >= similarity * (len(a) + len(b) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))
        W.make_room()

    return run


def _need(n: Column, m: Column, similarity: int) -> Column:
    """Least intersection of sets of n and m that are similar enough."""
    return F.ceil(F.lit(similarity) * (n + m) / F.lit(100 + similarity))


def _close(n: Column, pos: Column, m: Column, at: Column, similarity: int) -> Column:
    """Length and positional filters; no pair that links fails them."""
    length = (100 * F.least(n, m)) >= similarity * F.greatest(n, m)
    # what can be shared: this shingle, what precedes it on both sides, what follows it on both
    return length & (F.least(pos, at) + F.least(n - pos, m - at) >= _need(n, m, similarity))


def _differ(bits: Column, other: Column) -> Column:
    return sum((F.bit_count(F.get(bits, F.lit(k)).bitwiseXOR(F.get(other, F.lit(k)))) for k in range(BITS)), F.lit(0))


def _like(n: Column, bits: Column, m: Column, other: Column, similarity: int) -> Column:
    """Suffix filter on whole sets: as many elements differ as bits do, at least."""
    return _differ(bits, other) <= n + m - 2 * _need(n, m, similarity)


def _shared_prefixes(prefix: DataFrame, hot_from: int, scratch: Scratch) -> DataFrame:
    """(token, cls, n, pos, g): prefix rows whose shingle at least two classes have, and how many do.

    One exchange of all rows. A shingle's group has no more rows than the
    sketch counts in its bucket; the groups of buckets that hold far more than
    others (ranks from ``hot_from`` on) are dealt out by class as well, and
    counted by an aggregation that is written and joined back: so Spark can
    split a hot shingle's rows in that join.
    """
    hot = F.shiftrightunsigned("token", 48) >= hot_from
    spread = prefix.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).otherwise(-1))
    part = Window.partitionBy("token", "salt")
    kept = spread.withColumns({"lo": F.min("cls").over(part), "hi": F.max("cls").over(part)}).where("salt >= 0 OR lo < hi")
    kept = kept.groupBy("token", "salt", "cls").agg(F.first("n").alias("n"), F.first("pos").alias("pos")).withColumn("g", F.count("*").over(part))
    rows = scratch.keep(kept, "prefixes", compression="zstd")
    crowds = scratch.keep(rows.where("salt >= 0").groupBy("token").agg(F.count("*").alias("all")).where(F.col("all") > 1), "crowds")
    crowded = rows.where("salt >= 0").drop("g").join(crowds, "token").select("token", "cls", "n", "pos", F.col("all").alias("g"))
    group = scratch.keep(rows.where("salt < 0").select("token", "cls", "n", "pos", "g").unionAll(crowded), "prefixes", compression="zstd")
    scratch.drop(rows, crowds)
    return group


def _small_pairs(group: DataFrame, info: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) that share enough prefix shingles for what the suffixes can add."""
    x, y = group.alias("x"), group.alias("y")
    c = lambda side, name: F.col(f"{side}.{name}")
    met = x.join(y, (c("x", "token") == c("y", "token")) & (c("x", "cls") > c("y", "cls")) & _close(c("x", "n"), c("x", "pos"), c("y", "n"), c("y", "pos"), similarity))
    met = met.groupBy(c("x", "cls").alias("a"), c("y", "cls").alias("b")).agg(F.count("*").alias("shared"), F.first(c("x", "n")).alias("n"), F.first(c("y", "n")).alias("m"))
    n, m = F.col("n"), F.col("m")
    # A shared shingle is in both prefixes and counted (or hidden in a large group), or beyond one of them.
    beyond = F.greatest(F.ceil(F.lit(similarity) * n / 100) - 1, F.ceil(F.lit(similarity) * m / 100) - 1)
    enough = lambda hidden: F.col("shared") + hidden + beyond >= _need(n, m, similarity)
    more = info.where("hidden > 0").select("cls", "hidden")
    met = met.join(more.select(F.col("cls").alias("a"), F.col("hidden").alias("more")), "a", "left").join(more.select(F.col("cls").alias("b"), F.col("hidden").alias("most")), "b", "left")
    return met.where(enough(F.least(F.coalesce("more", F.lit(0)), F.coalesce("most", F.lit(0))))).select("a", "b")


def _pruned(pairs: DataFrame, info: DataFrame, similarity: int) -> DataFrame:
    """Suffix filter on distinct pairs, by bitmaps and then by histograms: (a, b, d), d the least number of elements that differ."""
    left = info.select(F.col("cls").alias("a"), F.col("n").alias("n"), F.col("bits").alias("left"), F.col("cells").alias("cells_a"))
    right = info.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("bits").alias("right"), F.col("cells").alias("cells_b"))
    both = pairs.join(left, "a").join(right, "b").where(_like(F.col("n"), F.col("left"), F.col("m"), F.col("right"), similarity))
    return both.select("a", "b", (F.col("n") + F.col("m") - 2 * _need(F.col("n"), F.col("m"), similarity)).cast("long").alias("most"), "cells_a", "cells_b").mapInArrow(_by_cells, "a long, b long, d long")


def _by_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    W.make_room()
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, CELLS).astype(np.int16) for k in (3, 4))
        d = np.abs(x - y).sum(1, dtype=np.int64)
        keep = pa.array(d <= np.asarray(batch.column(2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["a", "b", "d"]).filter(keep)


def _leader_pairs(group: DataFrame, info: DataFrame, leaders: int, similarity: int, scratch: Scratch) -> DataFrame:
    """Pairs of each class with its group's leaders: the first under some orders, wherever they appear.

    Leaders are found by an aggregation, written and joined back, so that a
    group of any size is spread over tasks.
    """
    order = lambda k: F.xxhash64(F.col("cls"), F.lit(k))
    held = group.join(info.select("cls", "bits"), "cls")
    heads = held.groupBy("token").agg(*(F.min(F.struct(order(k).alias("order"), "cls", "n", "pos", "bits")).alias(f"h{k}") for k in range(leaders)))
    heads = scratch.keep(heads.select("token", F.array_distinct(F.array(*(f"h{k}" for k in range(leaders)))).alias("heads")), "heads", compression="zstd")
    n, pos, bits = F.col("n"), F.col("pos"), F.col("bits")
    fit = lambda h: (h["cls"] != F.col("cls")) & _close(n, pos, h["n"], h["pos"], similarity) & _like(n, bits, h["n"], h["bits"], similarity)
    tied = held.join(heads, "token").select("cls", F.explode(F.transform(F.filter("heads", fit), lambda h: h["cls"])).alias("head"))
    return tied.select(F.greatest("cls", "head").alias("a"), F.least("cls", "head").alias("b"))


def _links(pairs: DataFrame, sets: DataFrame, similarity: int, scratch: Scratch) -> DataFrame:
    """Of distinct pairs (a, b), those that link, each verified once on whole sets (cls, grams)."""
    right = pairs.select("a", "b").join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("right")), "b")
    both = right.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("left")), "a").select("a", "b", "left", "right")
    with arrow_rows(scratch.spark, 512):
        found = scratch.keep(both.mapInArrow(_verifier(similarity), "a long, b long"), "links")
    release(scratch.spark)
    return found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY, leaders: int = LEADERS) -> DataFrame:
    """Component of every document under "shares enough shingles".

    A-Z are lower-cased; words are runs without space, tab to carriage return.
    A text of fewer than ``size`` words is one shingle; one without words, or a
    null, has an empty set, which links with nothing. Shingles are compared by
    64-bit hashes of their words. Returns doc_id, n_shingles, component_id: the
    smallest id reachable by links. Ids are integers; a null id gets its row,
    but names no component (one made of null ids alone is null). Repeated rows
    are copies; rows that share an id are sets of their own. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = session_of(docs)
    ready(spark)
    scratch = Scratch(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slim = slim.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("row"), "text")
    profile = scratch.keep(slim.mapInArrow(_profiler(size), _PROFILE), "profile", compression="zstd")
    # 1. Frequencies: at most BUCKETS rows come to the driver.
    seen = profile.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("seen").alias("seen")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[np.asarray(seen["bucket"])] = np.asarray(seen["seen"])
    rank = np.empty(BUCKETS, dtype=np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    ranks = spark.sparkContext.broadcast(rank)
    rows = profile.where("bucket IS NULL").select("doc_id", "row", "cls", "n", "bitmap", "cells")
    # 2. Prefixes, and of them those that at least two classes share.
    prefix = slim.where("text IS NOT NULL").select("text").mapInArrow(_prefixer(ranks, size, similarity), "token long, cls long, n int, pos int")
    group = _shared_prefixes(prefix, int((np.sort(counts) <= HOT * counts.mean()).sum()), scratch)
    ranks.destroy()
    release(spark)
    members = scratch.keep(rows.select("doc_id", "cls", F.col("n").alias("n_shingles")), "members")
    classes = rows.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.first("n").cast("int").alias("n"), F.first("bitmap").alias("bits"), F.first("cells").alias("cells"))
    crowded = group.where(F.col("g") > SMALL)
    hidden = crowded.groupBy("cls").agg(F.count("*").alias("hidden"))
    info = scratch.keep(classes.join(hidden, "cls", "left").withColumn("hidden", F.coalesce("hidden", F.lit(0))), "classes", compression="zstd")
    scratch.drop(profile)
    # 3. Pairs of small groups, counted; ties of large ones to leaders; with the bits that differ.
    drawn = scratch.keep(_small_pairs(group.where(F.col("g") <= SMALL), info, similarity).unionAll(_leader_pairs(crowded, info, leaders, similarity, scratch)).distinct(), "pairs")
    pairs = scratch.keep(_pruned(drawn, info, similarity), "pairs")
    scratch.drop(drawn)
    release(spark)
    # First each class's closest pair, then the closest of any two components.
    ends = pairs.select(F.col("a").alias("x"), "a", "b", "d").unionAll(pairs.select(F.col("b").alias("x"), "a", "b", "d"))
    closest = scratch.keep(ends.groupBy("x").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.a", "e.b").distinct(), "pairs")
    # These name every class that has a pair.
    sets = _sets_of(closest, info, slim, size, scratch)
    links = _links(closest, sets, similarity, scratch)
    roots = components(links, scratch)
    between = _apart(pairs, roots).groupBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.a", "e.b")
    joints = scratch.keep(between.join(links, ["a", "b"], "left_anti"), "pairs")
    if not joints.isEmpty():
        links = links.unionAll(_links(joints, sets, similarity, scratch))
        roots = components(links, scratch)
    scratch.drop(sets)
    # 4. All that is left, and all pairs of large groups, of classes that aren't connected yet.
    known = crowded.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    torn = scratch.keep(known.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token"), "torn")
    apart = known.join(torn, "token").join(info.select("cls", "bits"), "cls")
    x, y = apart.alias("x"), apart.alias("y")
    c = lambda side, name: F.col(f"{side}.{name}")
    rest = x.join(y, (c("x", "token") == c("y", "token")) & (c("x", "cls") > c("y", "cls")) & (c("x", "root") != c("y", "root")) & _close(c("x", "n"), c("x", "pos"), c("y", "n"), c("y", "pos"), similarity) & _like(c("x", "n"), c("x", "bits"), c("y", "n"), c("y", "bits"), similarity))
    left = _apart(pairs, roots).select("a", "b").unionAll(rest.select(c("x", "cls").alias("a"), c("y", "cls").alias("b"))).distinct()
    left = scratch.keep(_pruned(left.join(closest.unionAll(joints), ["a", "b"], "left_anti"), info, similarity), "pairs")
    if not left.isEmpty():
        links = links.unionAll(_links(left, _sets_of(left, info, slim, size, scratch), similarity, scratch))
        roots = components(links, scratch)
    # 5. Components carry the smallest id of their classes.
    named = info.select("cls", "rep").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    answer = named.select("cls", "root").join(least, "root").select("cls", "component_id")
    answer = materialize(members.join(answer, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    scratch.drop()
    release(spark)
    return answer


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose classes are in different components, with their roots."""
    a, b = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left").withColumns({"root_a": F.coalesce("root_a", "a"), "root_b": F.coalesce("root_b", "b")})
    return both.where("root_a <> root_b")


def _sets_of(pairs: DataFrame, info: DataFrame, slim: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """Whole sets (cls, grams) of the classes that the pairs name, one a class.

    A scan makes them anew from the texts; a filter of a fixed size keeps it
    from handing out most others, which the join drops.
    """
    classes = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = scratch.keep(info.select("cls", "row").join(classes, "cls"), "wanted")
    word = F.pmod(F.shiftrightunsigned("row", 6), F.lit(FILTER_WORDS)).cast("int")
    # At most FILTER_WORDS rows, whatever the corpus.
    got = wanted.select(word.alias("word"), F.expr("shiftleft(1L, cast(row & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_WORDS, dtype=np.uint64)
    bits[np.asarray(got["word"])] = np.asarray(got["bits"]).view(np.uint64)
    likely = scratch.spark.sparkContext.broadcast(bits)
    made = slim.where("text IS NOT NULL").select("row", "text").mapInArrow(_holder(likely, size), "row long, cls long, grams array<long>")
    # Repeated rows have equal sets, of which the verification may see any.
    sets = scratch.keep(made.join(wanted, ["row", "cls"], "left_semi").select("cls", "grams"), "sets")
    likely.destroy()
    scratch.drop(wanted)
    release(scratch.spark)
    return sets


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component: the one that names it; columns as before.

    Documents with a null id stay, as they can't be told apart. Of repeated
    rows with the kept id all stay; rows of different texts that share an id
    go together if one of them does.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    name = unused(docs, "gone")
    return docs.join(gone.withColumnRenamed("doc_id", name), F.col(id_col) == F.col(name), "left_anti")
