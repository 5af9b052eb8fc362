"""Aggregations: counts by status, weighted and robust scores, agreement, evaluation.

Each takes a table and the names of its columns, and groups by ``keys``. All
that is not a median is summed on the map side first; medians are exact and
hold a group's values, so keys must be takes, users or measures, not constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as X

#: Share of a group that must carry evidence before it has a score.
COVERAGE = 0.6


def gated(score: Column, scored: Column, total: Column, least: float = COVERAGE) -> Column:
    """The score, if enough of the group was scored."""
    return F.when((total > 0) & (scored / total >= least), score)


def count_by_status(df: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values), F.count("*").alias("total"))


def capped_loss(deviation: Column, tolerance: float, cap: float = 100.0) -> Column:
    return F.when(deviation.isNotNull(), F.least(F.greatest(F.abs(deviation) - tolerance, F.lit(0.0)), F.lit(cap)))


def weighted_capped_score(df: DataFrame, keys: list[str], deviation: str, weight: str, tolerance: float = X.TOLERANCE, least: float = COVERAGE) -> DataFrame:
    """100 less 1.2 times the weighted mean of what exceeds the tolerance, capped at 100."""
    loss = capped_loss(F.col(deviation), tolerance)
    w = F.when(F.col(deviation).isNotNull(), F.col(weight))
    out = df.groupBy(*keys).agg(F.sum(loss * w).alias("loss"), F.sum(w).alias("weight"), F.count(F.when(w > 0, 1)).alias("scored"), F.count("*").alias("total"))
    score = X.half_even(F.greatest(F.lit(0.0), 100.0 - 1.2 * F.col("loss") / F.col("weight")))
    return out.select(*keys, "scored", "total", gated(F.when(F.col("weight") > 0, score), F.col("scored"), F.col("total"), least).alias("score"))


def detrended_spread(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3, trend_from: int = 6, covered: float = COVERAGE) -> DataFrame:
    """Median offset, and median absolute deviation of y around its line over x.

    The offset is the median of y itself; the line counts for the spread alone,
    from ``trend_from`` rows on. Groups under ``least`` values, or with values
    for less than ``covered`` of their rows, have none. All steps are on the
    same keys, so one exchange of rows serves them.
    """
    w = Window.partitionBy(*keys)
    fit = df.withColumn("rows", F.count("*").over(w)).where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({
        "n": F.count("*").over(w), "slope": F.regr_slope(y, x).over(w), "mean_x": F.avg(x).over(w),
    })
    flat = fit.withColumn("level", F.when(F.col("n") >= trend_from, F.col(y) - F.coalesce("slope", F.lit(0.0)) * (F.col(x) - F.col("mean_x"))).otherwise(F.col(y)))
    centred = flat.withColumn("centre", F.median("level").over(w))
    out = centred.groupBy(*keys).agg(F.count("*").alias("n"), F.max("rows").alias("rows"), F.median(y).alias("offset"), F.median(F.abs(F.col("level") - F.col("centre"))).alias("spread"))
    enough = (F.col("n") >= least) & (F.col("n") / F.col("rows") >= covered)
    return out.select(*keys, "n", F.when(enough, F.col("offset")).alias("offset"), F.when(enough, F.col("spread")).alias("spread"))


def timing_accuracy(error_ms: Column, cap: float = 250.0) -> Column:
    """100 less .4 of the mean size of the errors, each capped: an aggregate."""
    return X.half_even(F.greatest(F.lit(0.0), 100.0 - F.avg(F.least(F.abs(error_ms), F.lit(cap))) * 0.4))


def struck_timing(df: DataFrame, keys: list[str], error_ms: str, least: int = 3, covered: float = 0.5, refused: str | None = None) -> DataFrame:
    """Offset, spread, stability, accuracy and score of the timing of struck notes, by medians.

    Rows are the notes in scope; n of them have an error. Nothing is said of
    fewer than ``least``, of less than a share of all notes but one, or of groups
    that ``refused`` (a boolean column) names.
    """
    w = Window.partitionBy(*keys)
    e = df.withColumn("offset", X.half_even(F.median(error_ms).over(w)))
    no = F.bool_or(F.coalesce(F.col(refused), F.lit(False))) if refused else F.lit(False)
    out = e.groupBy(*keys).agg(F.count(error_ms).alias("n"), F.count("*").alias("_rows"), no.alias("_no"), F.first("offset").alias("offset"), X.half_even(F.median(F.abs(F.col(error_ms) - F.col("offset")))).alias("spread"), F.median(F.abs(error_ms)).alias("size"))
    enough = (F.col("n") >= least) & (F.col("n") / F.greatest(F.lit(1), F.col("_rows") - 1) >= covered) & ~F.col("_no")
    floor = lambda lost: F.when(enough, X.half_even(F.greatest(F.lit(0.0), 100.0 - lost)))
    c = F.col
    out = out.where("n > 0")
    return out.select(*keys, "n", F.when(enough, c("offset")).alias("offset"), F.when(enough, c("spread")).alias("spread"), floor(c("spread") * 0.55).alias("stability"), floor(c("size") * 0.4).alias("accuracy"), floor(c("spread") * 0.45 + F.abs("offset") * 0.3).alias("score"))


def chord_spreads(notes: DataFrame, keys: list[str], chord: str, heard: str, staff: str, uneven_ms: float = 50.0, least: int = 3, *, rolled: str | None = None, measure: str | None = None, most: int = 8) -> DataFrame:
    """How evenly chords of two notes and more sound: chords, their median spread,
    how many are uneven, and by how much the first staff is later than the second
    (median over ``least`` chords that both play). Times are seconds. Chords with
    a note that is written rolled (a boolean column) are left out. With ``measure``
    also ``measures``: the ``most`` measures with most uneven chords."""
    c = F.col
    some = [F.bool_or(F.coalesce(c(rolled), F.lit(False))).alias("_rolled")] if rolled else [F.lit(False).alias("_rolled")]
    where = [F.min(measure).alias("_m")] if measure else []
    per = notes.groupBy(*keys, chord).agg(F.count("*").alias("n"), F.round((F.max(heard) - F.min(heard)) * 1000, 6).alias("spread"), F.round((F.median(F.when(c(staff) == 1, c(heard))) - F.median(F.when(c(staff) == 2, c(heard)))) * 1000, 6).alias("hands"), *some, *where)
    per = per.where("n >= 2 AND NOT _rolled")
    out = per.groupBy(*keys).agg(F.count("*").alias("chords"), X.half_even(F.median("spread")).alias("spread"), F.count_if(c("spread") > uneven_ms).alias("uneven"), F.count("hands").alias("both"), X.half_even(F.median("hands")).alias("hand_offset"))
    out = out.select(*keys, "chords", "spread", "uneven", F.when(c("both") >= least, c("hand_offset")).alias("hand_offset"))
    if not measure:
        return out
    worst = per.where(c("spread") > uneven_ms).groupBy(*keys, "_m").agg(F.count("*").alias("_k")).groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-c("_k")).alias("k"), c("_m").alias("m")))), 1, most).alias("_w"))
    return out.join(worst.select(*keys, F.transform("_w", lambda x: x["m"]).alias("measures")), keys, "left").withColumn("measures", F.coalesce("measures", F.array().cast(f"array<{notes.schema[measure].dataType.simpleString()}>")))


def trim_outliers(df: DataFrame, keys: list[str], value: str, tie: str, *, least: int, steady: float, beyond: float, share: float = 0.1, at_least: int = 2) -> DataFrame:
    """Rows with ``dropped``: in groups of ``least`` rows whose median size is
    steady, the values farthest from the median, beyond a limit, up to a share."""
    w = Window.partitionBy(*keys)
    far = df.withColumns({"n": F.count(value).over(w), "centre": F.median(value).over(w), "size": F.median(F.abs(value)).over(w)})
    far = far.withColumn("distance", F.abs(F.col(value) - F.col("centre")))
    rank = F.row_number().over(w.orderBy(F.desc_nulls_last("distance"), F.asc(tie)))
    cap = F.greatest(F.lit(at_least), F.floor(F.col("n") * share))
    dropped = (F.col("n") >= least) & (F.col("size") <= steady) & (F.col("distance") > beyond) & (rank <= cap)
    return far.withColumn("dropped", F.coalesce(dropped, F.lit(False))).drop("n", "centre", "size", "distance")


def measure_scores(notes: DataFrame, keys: list[str], measure: str, order: list[str], deviation: str, tolerance: float = X.TOLERANCE) -> DataFrame:
    """Score of each measure from its own notes and, at half weight, the last
    note of the measure before and the first of the one after.

    Every note is dealt to at most three measures, so the rows stay in
    proportion; measures are numbered densely within the keys.
    """
    w = Window.partitionBy(*keys).orderBy(measure)
    inside = Window.partitionBy(*keys, measure)
    n = notes.withColumns({
        "pos": F.dense_rank().over(w), "from_start": F.row_number().over(inside.orderBy(*order)), "from_end": F.row_number().over(inside.orderBy(*(F.desc(o) for o in order))),
    })
    ways = F.array_compact(F.array(
        F.struct(F.col("pos").alias("to"), F.lit(1.0).alias("share")),
        F.when(F.col("from_end") == 1, F.struct((F.col("pos") + 1).alias("to"), F.lit(0.5).alias("share"))),
        F.when(F.col("from_start") == 1, F.struct((F.col("pos") - 1).alias("to"), F.lit(0.5).alias("share"))),
    ))
    dealt = n.select(*keys, measure, "pos", F.col(deviation).alias("deviation"), F.explode(ways).alias("way"))
    loss = capped_loss(F.col("deviation"), tolerance)
    weight = F.when(F.col("deviation").isNotNull(), X.deviation_weight(F.col("deviation")) * F.col("way.share"))
    own = F.col("way.to") == F.col("pos")
    out = dealt.groupBy(*keys, F.col("way.to").alias("pos")).agg(
        F.max(F.when(own, F.col(measure))).alias(measure), F.count_if(own).alias("notes"), F.count_if(own & F.col("deviation").isNotNull()).alias("scored"),
        F.sum(loss * weight).alias("loss"), F.sum(weight).alias("weight"),
    ).where(F.col(measure).isNotNull())
    score = X.half_even(F.greatest(F.lit(0.0), 100.0 - 1.2 * F.round(F.col("loss") / F.col("weight"), 6)))
    return out.select(*keys, measure, "notes", "scored", gated(F.when(F.col("weight") > 0, score), F.col("scored"), F.col("notes")).alias("score"))


def coverage(part: Column, whole: Column) -> Column:
    """Share of the whole, 1 at most; null without a whole."""
    return F.when(whole > 0, F.least(F.lit(1.0), part / whole))


def confidence(share: Column) -> Column:
    return F.when(share.isNull(), "none").when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low")


def quantile_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.1)))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), p.alias("p")).select(*keys, "n", F.round(F.col("p")[0], 6).alias("median"), F.round(F.col("p")[1], 6).alias("p25"), F.round(F.col("p")[2], 6).alias("p10"))


def zero_filled(df: DataFrame, keys: list[str], bucket: str, counts: dict[str, Column], lo: int, hi: int) -> DataFrame:
    """Counts of every bucket from lo to hi, zero where there are no rows."""
    spark = df.sparkSession
    held = df.groupBy(*keys, bucket).agg(*(c.alias(n) for n, c in counts.items()))
    full = df.select(*keys).distinct().crossJoin(F.broadcast(spark.range(lo, hi + 1).select(F.col("id").cast(df.schema[bucket].dataType).alias(bucket)))) if keys else spark.range(lo, hi + 1).select(F.col("id").cast(df.schema[bucket].dataType).alias(bucket))
    return full.join(held, [*keys, bucket], "left").select(*keys, bucket, *(F.coalesce(n, F.lit(0)).alias(n) for n in counts))


def histogram(df: DataFrame, value: Column, width: float, reach: float) -> DataFrame:
    """Counts of bins of a width over -reach to reach; values beyond fall in the outer bins."""
    bins = int(2 * reach / width)
    bin_ = F.least(F.lit(bins - 1), F.floor((X.clamp(value, -reach, reach) + reach) / width)).cast("int")
    held = df.where(value.isNotNull()).select(bin_.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(held, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def multiset_f1(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """2 * shared / (left + right) over counts of elements; two empty bags agree fully."""
    a, b = F.coalesce(F.col(left), F.lit(0)), F.coalesce(F.col(right), F.lit(0))
    out = pairs.groupBy(*keys).agg(F.sum(F.least(a, b)).alias("shared"), F.sum(a + b).alias("both"))
    return out.select(*keys, F.when(F.col("both") == 0, 1.0).otherwise(2.0 * F.col("shared") / F.col("both")).alias("f1"))


def noisy_or(*doubts: Column) -> Column:
    out = F.lit(1.0)
    for d in doubts:
        out = out * (1.0 - F.coalesce(d, F.lit(0.0)))
    return 1.0 - out


def auc(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Chance that a positive scores above a negative, ties half: by ranks, not pairs.

    Rows collapse to (score, counts) before they are ordered, so a value that
    many rows share is one row.
    """
    held = df.where(F.col(score).isNotNull() & positive.isNotNull()).groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("p") * (F.coalesce(F.sum("q").over(w), F.lit(0)) + 0.5 * F.col("q"))
    out = held.withColumn("won", won).groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return out.select(*keys, F.col("p").alias("positives"), F.col("q").alias("negatives"), F.when(F.col("p") * F.col("q") > 0, F.col("won") / (F.col("p") * F.col("q"))).alias("auc"))


def precision_recall(matched: Column, found: Column, truth: Column) -> list[Column]:
    p, r = F.when(found > 0, matched / found), F.when(truth > 0, matched / truth)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1")]


def circular_mean(angle: Column, weight: Column) -> tuple[Column, Column]:
    """(direction, concentration from 0 to 1), as aggregates."""
    s, c, w = F.sum(weight * F.sin(angle)), F.sum(weight * F.cos(angle)), F.sum(weight)
    return F.atan2(s, c), F.when(w > 0, F.sqrt(s * s + c * c) / w)


def upper_median(value: Column) -> Column:
    """The middle element, the upper of two: an aggregate that never interpolates."""
    held = F.array_sort(F.collect_list(value))
    return F.try_element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int"))


def variation(df: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """Median and coefficient of variation of groups of ``least`` rows."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.stddev_pop(value).alias("sd"), F.avg(value).alias("mean"))
    return out.select(*keys, "n", F.round("median", 6).alias("median"), F.when((F.col("n") >= least) & (F.col("mean") != 0), F.round(F.col("sd") / F.col("mean"), 6)).alias("variation"))


def system_confidence(strength: str, gap: str) -> Column:
    """Half median strength, .3 regularity of gaps, .2 presence: an aggregate."""
    regular = F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.stddev_pop(gap) / F.nullif(F.avg(gap), F.lit(0.0)), F.lit(1.0)))
    return 0.5 * F.coalesce(upper_median(F.col(strength)), F.lit(0.0)) + 0.3 * regular + 0.2 * F.least(F.lit(1.0), F.count(strength) / 4.0)


def excess_doubt(df: DataFrame, keys: list[str], flagged: Column, wrong: Column, prior: float = 2.0) -> DataFrame:
    """How much more often flagged rows are wrong than others, shrunk by a prior count."""
    out = df.groupBy(*keys).agg(F.count_if(flagged).alias("n"), F.count_if(flagged & wrong).alias("k"), F.count_if(~flagged).alias("m"), F.count_if(~flagged & wrong).alias("j"))
    base = F.when(F.col("m") > 0, F.col("j") / F.col("m")).otherwise(0.0)
    return out.select(*keys, "n", F.greatest(F.lit(0.0), ((F.col("k") + prior * base) / (F.col("n") + prior) - base) / F.greatest(1.0 - base, F.lit(1e-9))).alias("doubt"))


def chords(df: DataFrame, keys: list[str], onset: str, member: str) -> DataFrame:
    """Rows with the same onset (to 4 decimals), as one sorted list of members."""
    return df.groupBy(*keys, F.round(onset, 4).alias("onset")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.count("*").alias("size"))


def weighted_f1(trust: Column, good: Column, written: Column, performed: Column) -> Column:
    """200 * good / (written + performed), each note weighed by trust: an aggregate."""
    top = F.sum(F.when(good, trust).otherwise(0.0))
    return F.when(F.sum(F.when(written, trust).otherwise(0.0)) + F.sum(F.when(performed, trust).otherwise(0.0)) > 0, 200.0 * top / (F.sum(F.when(written, trust).otherwise(0.0)) + F.sum(F.when(performed, trust).otherwise(0.0))))


def stage_summary(df: DataFrame, stage: str, seconds: str, failed: str) -> DataFrame:
    return df.groupBy(stage).agg(F.count("*").alias("count"), F.sum(seconds).alias("total"), F.avg(seconds).alias("average"), F.count_if(F.col(failed)).alias("failures"))
