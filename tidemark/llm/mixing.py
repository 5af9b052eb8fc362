"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys. Keys fall into equal ranges of the hash, so a
source of any size is sorted in many tasks: prefix sums of whole ranges are
summed over the (few) ranges of a source, those of documents within a range.
The mix cuts each source's order at the exact word where its budget ends;
where a budget exceeds the source, whole epochs come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACE_WORD, materialize, unused

#: Weights of the sources in order, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: Times that a source, and so a document, may be taken at most.
MOST = 3
#: Documents of a source in one range of hash keys, on average: what one task sorts.
RANGE_ROWS = 5_000
SEED = 20


def size_of(text: Column) -> Column:
    """Number of words: runs without space, tab to carriage return. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, documents -> the same and target.

    Sources in order of code points, null last, weigh ``weights`` in turn and
    share the sum of all sizes. A target stops at ``most`` times its source's
    size; the excess goes to the others by weight until none is above. That is
    one level L with target = least(weight * L, cap), and L follows from
    running sums over the sources in order of cap / weight. One row a source
    is sorted here, never documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (place % len(weights) + 1).cast("int")).cast("long")
    w = sources.withColumn("place", place).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("long"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = Window.partitionBy()
    w = w.withColumn("filled", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("all", F.sum("source_size").over(whole))
    w = w.withColumn("level", (F.col("all") - F.col("filled")).cast("double") / F.col("open").cast("double"))
    # The first source in that order whose cap isn't reached sets the level.
    w = w.withColumn("free", F.col("weight").cast("double") * F.col("level") <= F.col("cap").cast("double"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap").cast("double") / F.col("weight").cast("double"), F.col("place"), F.col("level").alias("level")))).over(whole)["level"]
    w = w.withColumn("common", level)
    target = F.when(F.col("common").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("weight").cast("double") * F.col("common"), F.col("cap").cast("double")))
    return w.select("source", "source_size", "documents", target.alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Of every document, how many of its words the mix takes.

    Returns doc_id, source, size, source_size, target (its source's), budget
    (the target as a whole number), before (words of the source ahead of it in
    hash order), epochs (times the whole source is taken), taken.

    A null text or one without words has size 0 and takes 0. Repeated rows are
    documents of their own; rows that tie in every column of the order are
    interchangeable, so reruns agree. Rows without an id get a key of their text. Other columns are ignored. An empty table
    gives an empty result.
    """
    # Rows without an id are told apart by their texts, so that their keys fall into all ranges.
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-:"), F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit(""))))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), named.alias("name"))
    slim = materialize(slim, "sizes")
    counted = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), weights, most)
    goal = counted.withColumn("budget", F.rint("target").cast("long")).withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("documents") / F.lit(range_rows)))).withColumnRenamed("source", "named")
    # 52 bits of a digest, so that the key is exact as a double
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("name"))), 1, 13), 16, 10).cast("long")
    keyed = slim.join(goal, F.col("source").eqNullSafe(F.col("named"))).withColumn("key", key)
    keyed = keyed.withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 52)) * F.col("ranges")).cast("long"))
    held = keyed.groupBy("source", "range").agg(F.sum("size").alias("held"))
    ahead = held.withColumn("ahead", F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("s"), F.col("range").alias("r"), "ahead")
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn("before", F.col("ahead") + F.col("within"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before")))
    return placed.withColumn("epochs", epochs).select("doc_id", "source", "size", "source_size", "target", "budget", "before", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def materialise(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: each document as often as it is taken; columns as before.

    Whole epochs repeat the document. The document at a cut comes once more if
    at least half of it lies within the budget, so a source misses its budget
    by half a document at most and texts stay whole. Documents that share an id
    (null included) are taken alike, as often as the most taken of them; so
    repeated ids can take a source over its budget. Null texts and texts
    without words are never taken. Columns, whatever their names, are as before.
    """
    times = mix(docs, id_col=id_col, **options)
    copies = times.groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)).cast("int").alias("copies"))
    mixed, many, one = (unused(docs, n) for n in ("mixed_id", "copies", "copy"))
    copies = copies.where("copies > 0").select(F.col("doc_id").alias(mixed), F.col("copies").alias(many))
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.join(copies, F.col(f"`{id_col}`").eqNullSafe(F.col(mixed)))
    return found.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*names)
