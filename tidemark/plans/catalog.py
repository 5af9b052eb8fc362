"""Registered queries over the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import aggregates as A
from tidemark.operators import matching as M
from tidemark.operators import quality as Q
from tidemark.operators import store as S
from tidemark.operators import windows as W
from tidemark.session import parts
from tidemark.sources.tables import days, events, load, seconds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Events with seconds and day numbers, as in sources.tables.events.
_E = "e AS (SELECT *, epoch_us(ts) / 1e6 AS t, CAST(epoch_us(ts) // 86400000000 AS INTEGER) AS day FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _deviations(spark: SparkSession, d: str) -> DataFrame:
    """Events with their deviation from the user's median."""
    e = events(spark, d)
    return e.withColumn("dev", F.round(F.col("value") - F.median("value").over(Window.partitionBy("user_id")), 6))


_DEV = _E + ", m AS (SELECT user_id, median(value) AS centre FROM e GROUP BY user_id), dev AS (SELECT e.*, round(value - centre, 6) AS dev FROM e JOIN m USING (user_id))"

_WEIGHT = "CASE WHEN dev IS NULL THEN 0.0 WHEN abs(dev) <= 150 THEN 1.0 WHEN abs(dev) > 600 THEN 0.0 ELSE greatest(0.3, 1.0 - (abs(dev) - 150.0) / 450.0) END"


@query(f"""
WITH {_DEV},
n AS (SELECT user_id, day, dev, dense_rank() OVER (PARTITION BY user_id ORDER BY day) AS pos,
  row_number() OVER (PARTITION BY user_id, day ORDER BY t, event_id) AS a, row_number() OVER (PARTITION BY user_id, day ORDER BY t DESC, event_id DESC) AS z FROM dev),
dealt AS (SELECT user_id, day, pos, pos AS dest, dev, 1.0 AS share FROM n UNION ALL
  SELECT user_id, day, pos, pos + 1, dev, 0.5 FROM n WHERE z = 1 UNION ALL SELECT user_id, day, pos, pos - 1, dev, 0.5 FROM n WHERE a = 1),
s AS (SELECT user_id, dest, max(day) FILTER (WHERE pos = dest) AS day, count(*) FILTER (WHERE pos = dest) AS notes, count(*) FILTER (WHERE pos = dest AND dev IS NOT NULL) AS scored,
  sum(CASE WHEN dev IS NOT NULL THEN least(greatest(abs(dev) - 25, 0), 100) * {_WEIGHT} * share END) AS loss, sum(CASE WHEN dev IS NOT NULL THEN {_WEIGHT} * share END) AS weight
  FROM dealt GROUP BY user_id, dest)
SELECT user_id, day, notes, scored, CASE WHEN notes > 0 AND scored / notes >= 0.6 AND weight > 0 THEN round_even(greatest(0.0, 100.0 - 1.2 * round(loss / weight, 6)), 0) END AS score FROM s WHERE day IS NOT NULL
""")
def measure_score(spark: SparkSession, d: str) -> DataFrame:
    return A.measure_scores(_deviations(spark, d), ["user_id"], "day", ["t", "event_id"], "dev")


@query(f"""
WITH {_DEV}, c AS (SELECT user_id, CASE WHEN dev IS NULL THEN 'uncertain' WHEN abs(abs(dev) - 1200) <= 80 THEN 'octave' WHEN abs(dev) > 1200 THEN 'outlier'
  WHEN abs(dev) <= 25 THEN 'correct' WHEN dev > 0 THEN 'sharp' ELSE 'flat' END AS status FROM dev)
SELECT user_id, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ('correct', 'sharp', 'flat', 'octave', 'outlier', 'uncertain'))}, count(*) AS total FROM c GROUP BY user_id
""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    dev = _deviations(spark, d).withColumn("status", X.classify_deviation(F.col("dev")))
    return A.count_by_status(dev, ["user_id"], "status", ["correct", "sharp", "flat", "octave", "outlier", "uncertain"])


@query("""
WITH l AS (SELECT l_suppkey, l_quantity - 25 AS dev, 1 - l_discount AS w FROM lineitem),
s AS (SELECT l_suppkey, sum(least(greatest(abs(dev) - 10, 0), 100) * w) AS loss, sum(w) AS weight, count(*) FILTER (WHERE w > 0) AS scored, count(*) AS total FROM l GROUP BY l_suppkey)
SELECT l_suppkey, scored, total, CASE WHEN total > 0 AND scored / total >= 0.6 AND weight > 0 THEN round_even(greatest(0, 100 - 1.2 * loss / weight), 0) END AS score FROM s
""")
def weighted_capped_score(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_discount").select("l_suppkey", (F.col("l_quantity") - 25).alias("dev"), (1 - F.col("l_discount")).alias("w"))
    return A.weighted_capped_score(l, ["l_suppkey"], "dev", "w", tolerance=10.0)


_GAPS = _E + ", g AS (SELECT user_id, row_number() OVER w AS i, t - lag(t) OVER w AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return events(spark, d).select("user_id", F.row_number().over(w).alias("i"), (F.col("t") - F.lag("t").over(w)).alias("gap"))


@query(f"""
WITH {_GAPS}, f AS (SELECT user_id, i, gap, count(*) OVER p AS n, regr_slope(gap, i) OVER p AS slope, avg(i) OVER p AS mx FROM g WHERE gap IS NOT NULL WINDOW p AS (PARTITION BY user_id)),
l AS (SELECT user_id, n, gap, CASE WHEN n >= 6 THEN gap - coalesce(slope, 0) * (i - mx) ELSE gap END AS level FROM f),
c AS (SELECT user_id, median(level) AS centre FROM l GROUP BY user_id), r AS (SELECT user_id, count(*) AS "all" FROM g GROUP BY user_id),
o AS (SELECT user_id, count(*) AS n, count(*) >= 3 AND count(*) / any_value("all") >= 0.6 AS enough, median(gap) AS off, median(abs(level - centre)) AS spread FROM l JOIN c USING (user_id) JOIN r USING (user_id) GROUP BY user_id)
SELECT user_id, n, CASE WHEN enough THEN round(off, 3) END AS "offset", CASE WHEN enough THEN round(spread, 3) END AS spread FROM o
""")
def rhythm_detrended_mad(spark: SparkSession, d: str) -> DataFrame:
    out = A.detrended_spread(_gaps(spark, d), ["user_id"], "i", "gap")
    return out.select("user_id", "n", F.round("offset", 3).alias("offset"), F.round("spread", 3).alias("spread"))


@query("""
WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice / 1000 AS v FROM orders),
m AS (SELECT o_custkey, median(v) AS centre, median(abs(v)) AS size, count(*) AS n FROM f GROUP BY o_custkey),
r AS (SELECT f.*, m.n, m.size, abs(v - centre) AS far, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(v - centre) DESC, o_orderkey) AS rank FROM f JOIN m USING (o_custkey))
SELECT o_custkey, o_orderkey, n >= 10 AND size <= 400 AND far > 100 AND rank <= greatest(2, floor(n * 0.1)) AS dropped FROM r
""")
def trim_outliers(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").withColumn("v", F.col("o_totalprice") / 1000)
    return A.trim_outliers(o, ["o_custkey"], "v", "o_orderkey", least=10, steady=400, beyond=100).select("o_custkey", "o_orderkey", "dropped")


@query("""
WITH c AS (SELECT source, count(quality) AS part, count(*) AS whole FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, part, whole, least(1.0, part / whole) AS coverage, CASE WHEN part / whole >= 0.8 THEN 'high' WHEN part / whole >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM c
""")
def coverage_confidence(spark: SparkSession, d: str) -> DataFrame:
    both = load(spark, d, "documents", "doc_id", "source").join(load(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    c = both.groupBy("source").agg(F.count("quality").alias("part"), F.count("*").alias("whole"))
    share = A.coverage(F.col("part"), F.col("whole"))
    return c.select("source", "part", "whole", share.alias("coverage"), A.confidence(share).alias("confidence"))


@query("""
SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def percentile_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.quantile_summary(load(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query(f"""
WITH {_DEV}, g AS (SELECT user_id, day, count(*) FILTER (WHERE abs(dev) > 100) AS red, count(*) FILTER (WHERE abs(dev) <= 25) AS green FROM dev GROUP BY user_id, day),
f AS (SELECT user_id, CAST(day AS INTEGER) AS day FROM (SELECT DISTINCT user_id FROM e), generate_series(19723, 19752) t(day))
SELECT user_id, day, coalesce(red, 0) AS red, coalesce(green, 0) AS green FROM f LEFT JOIN g USING (user_id, day)
""")
def report_by_bar_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    dev = _deviations(spark, d)
    grade = X.grade(F.col("dev"))
    return A.zero_filled(dev, ["user_id"], "day", {"red": F.count_if(grade == "red"), "green": F.count_if(grade == "green")}, 19723, 19752)


@query(f"""
WITH {_DEV}, h AS (SELECT least(15, floor((least(greatest(dev, -200), 200) + 200) / 25))::INTEGER AS bin FROM dev WHERE dev IS NOT NULL)
SELECT CAST(b AS INTEGER) AS bin, count(h.bin) AS n FROM generate_series(0, 15) t(b) LEFT JOIN h ON h.bin = b GROUP BY b
""")
def timing_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(_deviations(spark, d), F.col("dev"), 25.0, 200.0)


@query(f"""
WITH {_DEV} SELECT event_type, count(*) AS total, count(*) FILTER (WHERE dev > 25) AS sharp, count(*) FILTER (WHERE dev < -25) AS flat, count(*) FILTER (WHERE dev IS NULL OR abs(dev) > 1280) AS excluded FROM dev GROUP BY event_type
""")
def frequency_table(spark: SparkSession, d: str) -> DataFrame:
    dev = F.col("dev")
    return _deviations(spark, d).groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(dev > 25).alias("sharp"), F.count_if(dev < -25).alias("flat"), F.count_if(dev.isNull() | (F.abs(dev) > 1280)).alias("excluded"))


@query(f"""
WITH {_DEV}, b AS (SELECT user_id, day, sum(CASE WHEN abs(dev) <= 25 THEN 0 WHEN abs(dev) <= 50 THEN 1 WHEN abs(dev) <= 100 THEN 2 WHEN dev IS NULL THEN 0 ELSE 3 END)::BIGINT AS badness FROM dev GROUP BY user_id, day)
SELECT user_id, day, badness, row_number() OVER (PARTITION BY user_id ORDER BY badness DESC, day) AS rank FROM b WHERE badness >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY badness DESC, day) <= 5
""")
def top_practice_bars(spark: SparkSession, d: str) -> DataFrame:
    b = _deviations(spark, d).groupBy("user_id", "day").agg(F.sum(X.badness(X.grade(F.col("dev")))).alias("badness")).where("badness >= 2")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("badness"), "day"))
    return b.withColumn("rank", rank).where("rank <= 5").withColumn("rank", F.col("rank").cast("long"))


@query("""
WITH b AS (SELECT o_custkey, l_partkey % 50 AS part, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, CASE WHEN sum(a + b) = 0 THEN 1.0 ELSE round(2.0 * sum(least(a, b)) / sum(a + b), 9) END AS f1 FROM b GROUP BY o_custkey
""")
def multiset_f1(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").join(load(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    bags = lines.groupBy("o_custkey", (F.col("l_partkey") % 50).alias("part")).agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") != "R").alias("b"))
    return A.multiset_f1(bags, ["o_custkey"], "a", "b").select("o_custkey", F.round("f1", 9).alias("f1"))


@query("""
WITH x AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) FILTER (WHERE quality = 1) AS positives, count(*) FILTER (WHERE quality = 0) AS negatives,
  (SELECT round(avg(CASE WHEN p.n_chars > q.n_chars THEN 1.0 WHEN p.n_chars = q.n_chars THEN 0.5 ELSE 0.0 END), 9) FROM x p, x q WHERE p.lang = x.lang AND q.lang = x.lang AND p.quality = 1 AND q.quality = 0) AS auc FROM x GROUP BY lang
""")
def pairwise_auc(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "documents", "doc_id", "lang", "n_chars").join(load(spark, d, "labels", "doc_id", "quality"), "doc_id")
    return A.auc(x, ["lang"], "n_chars", F.col("quality") == 1).select("lang", "positives", "negatives", F.round("auc", 9).alias("auc"))


_TYPED = _E + ", a AS (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'view')"


def _typed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return events(spark, d).where(F.col("event_type") == kind).select("user_id", "t").distinct()


@query(f"""
WITH {_TYPED}, p AS (SELECT a.user_id, a.t AS ta, b.t AS tb, abs(a.t - b.t) AS gap FROM a JOIN b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 7200),
m AS (SELECT * FROM (SELECT user_id, ta, tb FROM p QUALIFY row_number() OVER (PARTITION BY user_id, ta ORDER BY gap, tb) = 1) INTERSECT SELECT * FROM (SELECT user_id, ta, tb FROM p QUALIFY row_number() OVER (PARTITION BY user_id, tb ORDER BY gap, ta) = 1)),
c AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM a) AS found, (SELECT count(*) FROM b) AS truth)
SELECT tp, found, truth, round(tp / found, 9) AS "precision", round(tp / truth, 9) AS recall FROM c
""")
def eval_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    a, b = _typed(spark, d, "click"), _typed(spark, d, "view")
    tp = M.mutual_nearest(a, b, ["user_id"], 7200.0).agg(F.count("*").alias("tp"))
    sizes = a.agg(F.count("*").alias("found")).join(b.agg(F.count("*").alias("truth")), how="cross")  # one row each
    p, r, _ = A.precision_recall(F.col("tp"), F.col("found"), F.col("truth"))
    return tp.join(sizes, how="cross").select("tp", "found", "truth", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"))


@query("SELECT c_custkey, c_name, o_orderkey, o_orderdate, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def history_join(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").where("c_mktsegment = 'BUILDING'")
    o = load(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_result FROM orders")
def has_result_flag(spark: SparkSession, d: str) -> DataFrame:
    held = load(spark, d, "lineitem", "l_orderkey").distinct()
    return load(spark, d, "orders", "o_orderkey").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("l_orderkey").isNotNull().alias("has_result"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07 UNION ALL SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def refcount_gc(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem", "l_partkey", "l_discount", "l_tax", "l_quantity")
    return S.unreferenced(load(spark, d, "part", "p_partkey"), "p_partkey", [l.where("l_discount > 0.09 AND l_tax > 0.07").select("l_partkey"), l.where("l_quantity > 49").select("l_partkey")])


@query(f"""
WITH {_TYPED}, p AS (SELECT a.user_id, a.t, b.t AS near FROM a LEFT JOIN b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 1800)
SELECT user_id, t, near FROM p QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY abs(near - t), near) = 1
""")
def nearest_onset(spark: SparkSession, d: str) -> DataFrame:
    return M.nearest(_typed(spark, d, "click"), _typed(spark, d, "view").withColumnRenamed("t", "_t"), ["user_id"], "t", "_t", "near", 1800.0)


def _order_spans(spark: SparkSession, d: str) -> DataFrame:
    ship = load(spark, d, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    o = load(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    both = o.join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_custkey", F.col("o_orderkey").alias("id"), days(F.col("o_orderdate")).cast("double").alias("start"), F.greatest(days(F.col("last")), days(F.col("o_orderdate")) + 1).cast("double").alias("stop"))


_SPANS = "s AS (SELECT o_custkey, o_orderkey AS id, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS start, greatest(date_diff('day', DATE '1970-01-01', max(l_shipdate)::DATE), date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 1)::DOUBLE AS stop FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate)"


@query(f"""
WITH {_SPANS} SELECT a.o_custkey, a.id AS left_id, b.id AS right_id, least(a.stop, b.stop) - greatest(a.start, b.start) AS overlap
FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.id % 2 = 0 AND b.id % 2 = 1 AND a.start < b.stop AND b.start < a.stop
QUALIFY row_number() OVER (PARTITION BY a.o_custkey, a.id ORDER BY least(a.stop, b.stop) - greatest(a.start, b.start) DESC, abs(a.start - b.start), b.id) = 1
""")
def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = _order_spans(spark, d)
    return M.best_overlap(s.where("id % 2 = 0"), s.where("id % 2 = 1"), ["o_custkey"], 120.0)


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-01') AS month FROM lineitem WHERE l_shipdate IS NOT NULL")
def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    """The month of every shipdate: the months go from the first one's to the last one's."""
    l = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").withColumn("bucket", F.year("l_shipdate"))
    ends = l.agg(F.min("l_shipdate").cast("date").alias("lo"), F.max("l_shipdate").cast("date").alias("hi"))
    m = ends.select(F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    m = m.select(F.year("month").alias("year"), F.col("month").cast("timestamp_ntz").alias("start"), F.add_months("month", 1).cast("timestamp_ntz").alias("stop"), "month")
    inside = (F.col("l_shipdate") >= F.col("start")) & (F.col("l_shipdate") < F.col("stop")) & (F.col("bucket") == F.col("year"))
    return l.join(F.broadcast(m), inside).select("l_orderkey", "l_linenumber", F.date_format("month", "yyyy-MM-dd").alias("month"))


@query(f"""
WITH {_E} SELECT a.event_id, b.value AS before FROM (SELECT * FROM e WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, t, max(value) AS value FROM e WHERE event_type = 'view' GROUP BY user_id, t) b ON a.user_id = b.user_id AND a.t >= b.t
""")
def asof_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    views = e.where("event_type = 'view'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    return M.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "t"), views, ["user_id"], "t", "t", "value", "before").select("event_id", "before")


@query(f"""
WITH {_E}, f AS (SELECT user_id, t AS x, value AS y FROM e QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY t, event_id) = 1),
a AS (SELECT user_id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM f WINDOW w AS (PARTITION BY user_id ORDER BY x))
SELECT e.event_id, round(CASE WHEN nx IS NULL THEN y ELSE y + (ny - y) * (t - x) / (nx - x) END, 6) AS y FROM e ASOF LEFT JOIN a ON e.user_id = a.user_id AND e.t >= a.x
""")
def interpolate_timeline(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    rank = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("t", "event_id"))
    anchors = e.withColumn("r", rank).where("r = 1").select("user_id", F.col("t").alias("x"), F.col("value").alias("v"))
    return M.interpolate(e.select("event_id", "user_id", "t"), anchors, ["user_id"], "t", "x", "v").select("event_id", F.round("y", 6).alias("y"))


@query(f"""
WITH {_E}, g AS (SELECT user_id, k * 60.0 AS shift, median(least((t - k * 60.0) % 3600, 3600 - (t - k * 60.0) % 3600)) AS residual FROM e, generate_series(0, 59) s(k) GROUP BY user_id, k)
SELECT user_id, shift::DOUBLE AS shift, round(residual, 3) AS residual FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(residual, 3), shift) = 1
""")
def grid_offset_fit(spark: SparkSession, d: str) -> DataFrame:
    """Of sixty shifts of an hourly grid, the one with the least median distance of a user's events."""
    return M.grid_offset(events(spark, d), ["user_id"], "t", 3600.0, [60.0 * k for k in range(60)])


@query(f"""
WITH {_E}, n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, t / 3600 AS b, value AS heard, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS written FROM e)
SELECT a.event_id, min(b.i) AS moved_from FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND a.i <> b.i AND b.i BETWEEN a.i - 4 AND a.i + 4 AND abs(a.b - b.b) <= 48 AND abs(b.written - a.heard) <= 0.5 GROUP BY a.event_id
""")
def displaced_match(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    n = events(spark, d).select("user_id", "event_id", F.row_number().over(w).cast("long").alias("i"), (F.col("t") / 3600).alias("b"), F.col("value").alias("heard"), F.lag("value").over(w).alias("written"))
    return M.displaced(n, ["user_id"], "i", "b", "heard", "written", beats=48.0).select("event_id", "moved_from")


@query("SELECT o_orderkey AS id, 'missed' AS kind FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT DISTINCT l_orderkey, 'extra' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)")
def missed_and_extra(spark: SparkSession, d: str) -> DataFrame:
    # Both sides are dealt out by id before anything is kept: ids pack so well that Spark would join parts until one holds a hundred million.
    o, l = (load(spark, d, table, key).toDF("id").repartition(parts(spark), "id") for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")))
    l = l.distinct()
    return M.unmatched(o, l, ["id"]).withColumn("kind", F.lit("missed")).unionByName(M.unmatched(l, o, ["id"]).withColumn("kind", F.lit("extra")))


@query("SELECT o_orderkey AS id, o_orderdate AS updated FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    cloud = load(spark, d, "orders", "o_orderkey", "o_orderdate").toDF("id", "updated")
    return M.merge_plan(load(spark, d, "lineitem", "l_orderkey").toDF("id").distinct(), cloud, "id", "updated", 10)


@query(f"""
WITH {_E}, u AS (SELECT DISTINCT user_id, day FROM e), r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM u)
SELECT user_id, min(day) AS "first", max(day) AS "last", count(*) AS n, count(*) AS measures FROM r GROUP BY user_id, g HAVING count(*) >= 2
""")
def islands_runs(spark: SparkSession, d: str) -> DataFrame:
    return W.dense_runs(events(spark, d).select("user_id", "day").distinct(), ["user_id"], "day", 1, 2, measures=2)


@query(f"WITH {_E}, g AS (SELECT user_id, t AS start, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS stop FROM e) SELECT user_id, start, stop FROM g WHERE stop - start > 86400")
def silence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return W.silence_gaps(events(spark, d), ["user_id"], "t", 86400.0)


@query(f"""
WITH {_SPANS}, m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY o_custkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT o_custkey, min(start) AS start, max(stop) AS stop, count(*) AS n FROM i GROUP BY o_custkey, g
""")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return W.merge_intervals(_order_spans(spark, d), ["o_custkey"], "start", "stop")


@query(f"WITH {_E} SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS label FROM e")
def causal_labels(spark: SparkSession, d: str) -> DataFrame:
    return W.running_max(events(spark, d), ["user_id"], ["t", "event_id"], "value", "label").select("event_id", "label")


@query(f"""
WITH RECURSIVE {_E}, o AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM (SELECT DISTINCT user_id, t FROM e)),
k AS (SELECT user_id, i, t, t AS kept FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.t, CASE WHEN o.t > k.kept + 3600 THEN o.t ELSE k.kept END FROM k JOIN o ON o.user_id = k.user_id AND o.i = k.i + 1)
SELECT DISTINCT user_id, kept AS t FROM k
""")
def onset_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return W.dedupe_onsets(events(spark, d), ["user_id"], "t", 3600.0)


@query(f"""
WITH RECURSIVE {_E}, o AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
k AS (SELECT user_id, i, t, t AS start FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.t, CASE WHEN o.t - k.t <= 14400 AND o.t - k.start <= 43200 THEN k.start ELSE o.t END FROM k JOIN o ON o.user_id = k.user_id AND o.i = k.i + 1)
SELECT user_id, start, max(t) AS stop, count(*)::INTEGER AS n FROM k GROUP BY user_id, start
""")
def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    return W.clusters(events(spark, d), ["user_id"], "t", 14400.0, 43200.0)


@query(f"""
WITH {_E}, s AS (SELECT user_id, min(t) AS a, max(t) AS b FROM e GROUP BY user_id), g AS (SELECT user_id, k::INTEGER AS k, round(a + (b - a) * k / 16, 3) AS t FROM s, generate_series(0, 15) q(k))
SELECT *, ((k // 4) + 1)::BIGINT AS phrase FROM g
""")
def equal_grid_phrases(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return W.phrases(W.equal_grid(s, ["user_id"], "a", "b", 16).withColumn("t", F.round("t", 3)), ["user_id"], "k", 4)


@query(f"""
WITH {_E}, n AS (SELECT user_id, event_id, t, value, ((row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1) * 10 // greatest(count(*) OVER (PARTITION BY user_id), 10)) AS bucket FROM e)
SELECT user_id, bucket, event_id, count(*) OVER (PARTITION BY user_id, bucket) AS size FROM n QUALIFY row_number() OVER (PARTITION BY user_id, bucket ORDER BY value DESC NULLS LAST, t, event_id) = 1
""")
def downsample_argmax(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("o", F.struct("t", "event_id"))
    return W.downsample(e, ["user_id"], "o", "value", 10).select("user_id", "bucket", "event_id", "size")


@query(f"""
WITH {_E}, s AS (SELECT event_type, day, round(sum(value), 3) AS total FROM e GROUP BY event_type, day),
l AS (SELECT event_type, day, round(CASE WHEN count(*) OVER w >= 2 AND max(day) OVER w > min(day) OVER w THEN avg(total) OVER w + regr_slope(total, day) OVER w * (day - avg(day) OVER w) ELSE avg(total) OVER w END, 6) AS line FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT event_type, day, round(max(line) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING), 3) AS smooth FROM l
""")
def local_smoothing(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).groupBy("event_type", "day").agg(F.round(F.sum("value"), 3).alias("total"))
    return W.local_line(s, ["event_type"], "day", "total", 2).select("event_type", "day", F.round("smooth", 3).alias("smooth"))


@query("""
WITH o AS (SELECT o_custkey, epoch_us(o_orderdate) / 86400e6 AS q, o_totalprice AS y FROM orders), p AS (SELECT a.o_custkey, median((b.y - a.y) / (b.q - a.q)) AS slope, count(*) AS pairs FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.q - a.q >= 30 GROUP BY a.o_custkey)
SELECT o_custkey, pairs, round(slope, 6) AS slope, round(median(y - slope * q), 3) AS intercept FROM o JOIN p USING (o_custkey) GROUP BY o_custkey, pairs, slope
""")
def theil_sen(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.alignment import theil_sen as line

    o = load(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").select("o_custkey", (seconds(F.col("o_orderdate")) * 1e6 / 86400e6).alias("q"), F.col("o_totalprice").alias("y"))
    return line(o, ["o_custkey"], "q", "y", 30.0).select("o_custkey", "pairs", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(f"""
WITH {_E}, v AS (SELECT user_id, s, avg(CASE WHEN least(t % (3600 * s), 3600 * s - t % (3600 * s)) <= 300 * s THEN 1.0 ELSE 0.0 END) AS rate FROM e, (VALUES (1.0), (1.5), (0.5)) q(s) GROUP BY user_id, s)
SELECT user_id, s::DOUBLE AS scale, round(rate, 9) AS rate FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(rate, 9) DESC, s) = 1
""")
def scale_vote(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.alignment import vote

    tried = events(spark, d).select("user_id", "t", F.explode(F.array(F.lit(1.0), F.lit(1.5), F.lit(0.5))).alias("scale"))
    step = F.col("scale") * 3600
    phase = F.pmod(F.col("t"), step)
    return vote(tried, ["user_id"], "scale", F.least(phase, step - phase) <= F.col("scale") * 300)


@query(f"""
WITH {_E}, c AS (SELECT user_id AS u, count(*) AS notes, count(*) FILTER (WHERE value > 8) AS scored, count(*) FILTER (WHERE value > 30) AS correct, count(*) FILTER (WHERE value > 4) AS voiced, count(*) FILTER (WHERE event_type <> 'error') AS timed, count(*) FILTER (WHERE value > 120) AS outliers FROM e GROUP BY user_id),
r AS (SELECT *, least(1.0, scored / notes) AS pc, CASE WHEN notes > 1 THEN least(1.0, timed / (notes - 1)) ELSE 0.0 END AS tc, least(1.0, voiced / notes) AS heard, CASE WHEN u % 7 <> 3 THEN (scored % 101)::DOUBLE END AS pitch, CASE WHEN u % 7 NOT IN (3, 4) THEN (timed % 101)::DOUBLE END AS rhythm,
  u % 6 = 0 AS rejected, u % 12 = 6 AS lone, u % 5 = 0 AS faster, u % 4 = 0 AS unaligned, u % 2 = 0 AS rescued, CASE WHEN scored >= 12 THEN round(correct / scored, 3) END AS rate FROM c),
f AS (SELECT *, pc < 0.6 OR u % 11 = 0 AS thin, faster AND coalesce(rhythm < 60, false) AS slack, voiced > 0 AND outliers / greatest(voiced, 1) >= 0.2 AS astray FROM r),
m AS (SELECT *, coalesce(rate < 0.4, false) AND (unaligned OR pitch IS NULL OR thin) AND NOT rescued AS miss, (pitch IS NOT NULL)::INTEGER + (rhythm IS NOT NULL)::INTEGER AS k FROM f),
w AS (SELECT *, k = 2 AND NOT unaligned AND (NOT thin OR (heard >= 0.6 AND pc >= 0.5 AND NOT miss)) AND NOT astray AND NOT slack AS whole FROM m)
SELECT u AS user_id, CASE WHEN k = 0 AND u % 10 = 3 THEN 'score_unreliable' WHEN k = 0 THEN 'insufficient_evidence' WHEN miss THEN 'score_audio_mismatch' WHEN k < 2 OR unaligned OR thin OR astray OR slack OR u % 17 = 0 THEN 'partial' WHEN rescued THEN 'complete_with_rescue' ELSE 'complete' END AS outcome,
  CASE WHEN whole THEN floor(pitch * 0.5 + rhythm * 0.5 + 0.5) END AS overall, CASE WHEN whole THEN CASE WHEN thin THEN 'reference' ELSE 'full' END END AS reliability, rate AS match_rate, round(pc, 3) AS pitch_coverage, round(tc, 3) AS timing_coverage, round(1 - heard, 3) AS unheard,
  u % 9 <> 0 AND u % 11 <> 0 AND NOT unaligned AND NOT miss AS follow_ready,
  concat_ws(',', CASE WHEN unaligned THEN 'alignment_unverified' END, CASE WHEN u % 3 = 0 AND NOT lone THEN 'builtin_detectors' END, CASE WHEN rejected THEN 'beat_grid_rejected' END, CASE WHEN u % 8 = 0 THEN 'clipped_audio' END, CASE WHEN thin THEN 'low_coverage' END, CASE WHEN faster THEN 'tempo_mismatch' END,
    CASE WHEN slack THEN 'tempo_timing_unreliable' END, CASE WHEN u % 10 = 3 THEN 'score_unreliable' END, CASE WHEN u % 13 = 0 THEN 'take_beyond_score' END, CASE WHEN astray THEN 'pitch_tracking_unreliable' END, CASE WHEN miss THEN 'score_audio_mismatch' END) AS issues FROM w
""")
def quality_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of users' takes, with the evidence drawn from their events and ids."""
    u, c = F.col("user_id"), F.count_if
    counts = events(spark, d).groupBy("user_id").agg(F.count("*").alias("notes"), c(F.col("value") > 8).alias("scored"), c(F.col("value") > 30).alias("correct"), c(F.col("value") > 4).alias("voiced"), c(F.col("event_type") != "error").alias("timed"), c(F.col("value") > 120).alias("outliers"))
    lone, every = F.array(F.lit("beat:rejected")), F.array(F.lit("beat:rejected"), F.lit("pitch:builtin"))
    rows = counts.withColumns({
        "timing_candidates": F.col("notes") - 1, "octaves": F.lit(0), "excluded": F.lit(None).cast("long"), "pitch": F.when(u % 7 != 3, (F.col("scored") % 101).cast("double")), "rhythm": F.when(~(u % 7).isin(3, 4), (F.col("timed") % 101).cast("double")),
        "reasons": F.when(u % 12 == 6, lone).when(u % 6 == 0, every), "unaligned": u % 4 == 0, "degraded": u % 3 == 0, "clipped": u % 8 == 0, "unsure": u % 11 == 0, "tempo_mismatch": u % 5 == 0, "refused": u % 10 == 3, "beyond_score": u % 13 == 0, "rescued": u % 2 == 0, "range_rescue": u % 17 == 0, "timeline": u % 9 != 0,
    })
    return Q.verdict(rows).select("user_id", "outcome", "overall", "reliability", "match_rate", "pitch_coverage", "timing_coverage", "unheard", "follow_ready", F.array_join("issues", ",").alias("issues"))


@query("""
WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s, count(DISTINCT l_linestatus) AS states FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, concat_ws(',', CASE WHEN s > o_totalprice * 1.5 THEN 'voice_overfull' END, CASE WHEN s < o_totalprice * 0.5 THEN 'voice_short' END, CASE WHEN states > 1 THEN 'staff_mismatch' END) AS symptoms,
  round(greatest(CASE WHEN s > o_totalprice * 1.5 THEN 0.8 ELSE 0 END, CASE WHEN s < o_totalprice * 0.5 THEN 0.75 ELSE 0 END, CASE WHEN states > 1 THEN 0.85 ELSE 0 END), 6)::DOUBLE AS doubt
FROM orders JOIN l ON l_orderkey = o_orderkey
""")
def rule_symptoms(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_linestatus").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("s"), F.count_distinct("l_linestatus").alias("states"))
    both = load(spark, d, "orders", "o_orderkey", "o_totalprice").join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    held = Q.symptoms(both, {"voice_overfull": F.col("s") > F.col("o_totalprice") * 1.5, "voice_short": F.col("s") < F.col("o_totalprice") * 0.5, "staff_mismatch": F.col("states") > 1})
    return held.select("o_orderkey", F.array_join("symptoms", ",").alias("symptoms"), "doubt")


@query(f"WITH {_E} SELECT user_id, event_type, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC, event_id DESC) = 1")
def latest_wins_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return S.upsert(old, new, ["user_id", "event_type"], ["t", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies, max(n_chars) AS size FROM documents WHERE text IS NOT NULL GROUP BY text")
def content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents", "doc_id", "text", "n_chars").where("text IS NOT NULL")
    return S.by_content(docs, F.col("text"), "doc_id", "n_chars")


@query(f"WITH {_E} SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS used, count(*) > 3 AS over FROM e GROUP BY ALL")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.stateful import daily_usage

    return daily_usage(load(spark, d, "events", "user_id", "ts", "event_type"), "user_id", "ts", "event_type", 3)


@query("SELECT event_id, count(*) OVER w AS recent, count(*) OVER w > 2 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def sliding_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.stateful import rate_limited

    return rate_limited(load(spark, d, "events", "event_id", "user_id", "ts"), ["user_id"], "ts", 3600, 2).select("event_id", "recent", "limited")


@query("SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS expired FROM events WHERE event_type = 'purchase'")
def ttl_expiry(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "ts", "event_type")
    return S.expired(e.where("event_type = 'purchase'"), e, "ts", 7 * 86400).select("event_id", "expired")


@query("""
WITH p AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)
SELECT event_id, k, concat_ws(',', CASE WHEN k IS NULL THEN 'k_missing' END, CASE WHEN k NOT BETWEEN 0 AND 90 THEN 'k_range' END, CASE WHEN value IS NULL OR value < 0 THEN 'value_range' END) AS faults FROM p
""")
def json_prop_guard(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "value", "props").withColumn("k", F.from_json("props", "k BIGINT")["k"])
    held = Q.guard(e, {"k_missing": F.col("k").isNull(), "k_range": ~F.col("k").between(0, 90), "value_range": F.col("value").isNull() | (F.col("value") < 0)})
    return held.select("event_id", "k", F.array_join("faults", ",").alias("faults"))
