"""Registered queries of takes: scores and agreement, rules of measures, matching, sessions and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import matching as M
from tidemark.operators import pairing as P
from tidemark.operators import performance as R
from tidemark.operators import quality as Q
from tidemark.operators import store as S
from tidemark.plans.catalog import _DEV, _E, _deviations, query
from tidemark.sources.tables import events, load
from tidemark.streaming import stateful as ST


@query(f"""
WITH {_DEV}, s AS (SELECT user_id, count(dev) AS scored, count(*) AS total, avg(least(greatest(abs(dev) - 25, 0), 100)) AS lost FROM dev GROUP BY user_id)
SELECT user_id, scored, total, CASE WHEN scored / total >= 0.6 THEN round_even(greatest(0.0, 100.0 - 1.2 * round(lost, 9)), 0) END AS score FROM s
""")
def gate_scores(spark: SparkSession, d: str) -> DataFrame:
    """The capped score without weights, as gates read it."""
    e = _deviations(spark, d)
    lost = e.groupBy("user_id").agg(F.count("dev").alias("scored"), F.count("*").alias("total"), F.round(F.avg(A.capped_loss(F.col("dev"), 25.0)), 9).alias("lost"))
    score = F.rint(F.greatest(F.lit(0.0), 100.0 - 1.2 * F.col("lost")))
    return lost.select("user_id", "scored", "total", A.gated(score, F.col("scored"), F.col("total")).alias("score"))


_ERRORS = _E + ", x AS (SELECT user_id, event_id, event_type, ((event_id * 7919 % 1001 - 500)::DOUBLE / 2) AS err FROM e)"


def _errors(spark: SparkSession, d: str) -> DataFrame:
    """Events with a timing error in milliseconds, from -250 to 250, derived from the id."""
    return events(spark, d).select("user_id", "event_id", "event_type", ((F.col("event_id") * 7919 % 1001 - 500) / 2.0).alias("err"))


@query(f"WITH {_ERRORS} SELECT user_id, round_even(greatest(0.0, 100.0 - avg(least(abs(err), 250.0)) * 0.4), 0) AS accuracy FROM x GROUP BY user_id")
def timing_accuracies(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d).groupBy("user_id").agg(A.timing_accuracy(F.col("err")).alias("accuracy"))


@query(f"""
WITH {_ERRORS}, o AS (SELECT user_id, round_even(median(err), 0) AS o FROM x GROUP BY user_id), s AS (SELECT user_id, count(*) AS n, any_value(o) AS o, round_even(median(abs(err - o)), 0) AS s, median(abs(err)) AS m FROM x JOIN o USING (user_id) GROUP BY user_id)
SELECT user_id, n, CASE WHEN n >= 3 THEN o END AS "offset", CASE WHEN n >= 3 THEN s END AS spread, CASE WHEN n >= 3 THEN round_even(greatest(0.0, 100.0 - s * 0.55), 0) END AS stability,
  CASE WHEN n >= 3 THEN round_even(greatest(0.0, 100.0 - m * 0.4), 0) END AS accuracy, CASE WHEN n >= 3 THEN round_even(greatest(0.0, 100.0 - (s * 0.45 + abs(o) * 0.3)), 0) END AS score FROM s
""")
def struck_timing(spark: SparkSession, d: str) -> DataFrame:
    return A.struck_timing(_errors(spark, d), ["user_id"], "err")


@query(f"""
WITH {_ERRORS}, c AS (SELECT user_id, event_id // 40 AS chord, count(*) AS n, (max(err) - min(err)) AS spread, median(err) FILTER (WHERE event_id % 2 = 0) - median(err) FILTER (WHERE event_id % 2 = 1) AS hands FROM x GROUP BY user_id, chord)
SELECT user_id, count(*) AS chords, round_even(median(round(spread, 6)), 0) AS spread, count(*) FILTER (WHERE round(spread, 6) > 300) AS uneven, CASE WHEN count(hands) >= 3 THEN round_even(median(round(hands, 6)), 0) END AS hand_offset FROM c WHERE n >= 2 GROUP BY user_id
""")
def chord_spread(spark: SparkSession, d: str) -> DataFrame:
    e = _errors(spark, d).select("user_id", F.floor(F.col("event_id") / 40).alias("chord"), (F.col("err") / 1000).alias("heard"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(2).alias("staff"))
    return A.chord_spreads(e, ["user_id"], "chord", "heard", "staff", uneven_ms=300.0)


@query(f"""
WITH {_E} SELECT user_id, round(200.0 * sum(CASE WHEN value > 50 THEN value % 10 / 10 ELSE 0 END) / (sum(value % 10 / 10) + sum(CASE WHEN event_type <> 'error' THEN value % 10 / 10 ELSE 0 END)), 6) AS f1 FROM e GROUP BY user_id
""")
def evidence_f1(spark: SparkSession, d: str) -> DataFrame:
    good, played = F.col("value") > 50, F.col("event_type") != "error"
    return events(spark, d).groupBy("user_id").agg(F.round(A.weighted_f1(F.col("value") % 10 / 10, good, F.lit(True), played), 6).alias("f1"))


@query("SELECT event_type AS stage, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 6) AS average, count(*) FILTER (WHERE value > 100) AS failures FROM events GROUP BY event_type")
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_type", "value").withColumn("failed", F.col("value") > 100).withColumnRenamed("event_type", "stage")
    out = A.stage_summary(e, "stage", "value", "failed")
    return out.select("stage", "count", F.round("total", 4).alias("total"), F.round("average", 6).alias("average"), "failures")


@query("""
WITH l AS (SELECT l_orderkey, l_discount * 10 AS s, l_quantity AS g FROM lineitem)
SELECT l_orderkey, round(0.5 * list_sort(list(s))[count(*) // 2 + 1] + 0.3 * greatest(0.0, 1.0 - stddev_pop(g) / avg(g)) + 0.2 * least(1.0, count(*) / 4.0), 6) AS confidence FROM l GROUP BY l_orderkey
""")
def system_confidences(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem", "l_orderkey", "l_discount", "l_quantity").withColumns({"s": F.col("l_discount") * 10, "g": F.col("l_quantity")})
    return l.groupBy("l_orderkey").agg(F.round(A.system_confidence("s", "g"), 6).alias("confidence"))


@query("""
WITH c AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n, count(*) FILTER (WHERE l_returnflag = 'R' AND l_tax > 0.05) AS k, count(*) FILTER (WHERE l_returnflag <> 'R') AS m, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_tax > 0.05) AS j FROM lineitem GROUP BY l_suppkey),
b AS (SELECT *, CASE WHEN m > 0 THEN j / m ELSE 0 END AS base FROM c)
SELECT l_suppkey, n, round(greatest(0.0, ((k + 2.0 * base) / (n + 2.0) - base) / greatest(1.0 - base, 1e-9)), 6) AS doubt FROM b
""")
def symptom_doubt(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_tax")
    return A.excess_doubt(l, ["l_suppkey"], F.col("l_returnflag") == "R", F.col("l_tax") > 0.05).select("l_suppkey", "n", F.round("doubt", 6).alias("doubt"))


# Rules of measures: an order is a measure, its lines are notes.


@query("""
WITH v AS (SELECT l_orderkey, l_linestatus, sum(l_quantity) AS held, max(CASE WHEN l_orderkey % 2 = 0 THEN 60 ELSE 75 END)::DOUBLE AS nominal, bool_or(l_orderkey % 17 = 0) AS edge FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linestatus, held, CASE WHEN held > nominal THEN 'voice_overfull' WHEN NOT edge AND held < nominal THEN 'voice_short' END AS symptom FROM v
""")
def voice_fullness(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_quantity").withColumn("nominal", F.when(F.col("l_orderkey") % 2 == 0, 60.0).otherwise(75.0))
    return Q.fullness(l, ["l_orderkey", "l_linestatus"], "l_quantity", "nominal", F.col("l_orderkey") % 17 == 0).select("l_orderkey", "l_linestatus", "held", "symptom")


@query("WITH v AS (SELECT l_orderkey, l_linestatus, sum(l_quantity) AS held FROM lineitem GROUP BY ALL) SELECT l_orderkey, max(held) - min(held) AS difference FROM v GROUP BY l_orderkey HAVING max(held) - min(held) > 1e-6")
def staff_mismatches(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_quantity").groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").alias("held"))
    return Q.staff_mismatch(v, ["l_orderkey"], "held")


@query("""
WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS dots, CASE WHEN l_suppkey % 4 = 0 THEN 3 END AS actual, CASE WHEN l_suppkey % 4 = 0 THEN 2 END AS normal, ([8.0, 4.0, 2.0, 1.0, 0.5, 0.25, 0.125, 0.0625])[1 + l_partkey % 8]::DOUBLE AS base FROM lineitem)
SELECT l_orderkey, l_linenumber, round(base * (2.0 - pow(0.5, dots)) * coalesce(normal, 1) / coalesce(actual, 1), 9) AS quarters FROM k
""")
def type_durations(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*(F.lit(x) for x in ("breve", "whole", "half", "quarter", "eighth", "16th", "32nd", "64th")))
    kind = F.element_at(kinds, (F.col("l_partkey") % 8 + 1).cast("int"))
    tuplet = F.col("l_suppkey") % 4 == 0
    l = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return l.select("l_orderkey", "l_linenumber", F.round(Q.type_duration(kind, F.col("l_partkey") % 3, F.when(tuplet, 3), F.when(tuplet, 2)), 9).alias("quarters"))


@query("""
WITH b AS (SELECT l_orderkey, sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS open FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, open::BIGINT AS open FROM b WHERE open <> 0
""")
def open_beams(spark: SparkSession, d: str) -> DataFrame:
    beam = F.when(F.col("l_returnflag") == "A", "begin").when(F.col("l_returnflag") == "R", "end").otherwise("continue")
    return Q.open_beams(load(spark, d, "lineitem", "l_orderkey", "l_returnflag").withColumn("beam", beam), ["l_orderkey"], "beam")


@query("""
WITH n AS (SELECT l_suppkey, l_partkey % 5 AS key, l_linestatus AS voice, l_quantity / 4 AS onset FROM lineitem)
SELECT DISTINCT a.l_suppkey FROM n a JOIN n b ON a.l_suppkey = b.l_suppkey AND a.key = b.key AND a.voice <> b.voice AND abs(a.onset - b.onset) < 1
""")
def voice_echoes(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_linestatus", "l_quantity")
    n = n.select("l_suppkey", (F.col("l_partkey") % 5).alias("key"), F.col("l_linestatus").alias("voice"), (F.col("l_quantity") / 4).alias("onset"))
    return Q.echoes(n, ["l_suppkey"], "key", "voice", "onset")


@query("""
WITH m AS (SELECT l_suppkey, l_orderkey, sum(l_quantity) AS held, CASE WHEN l_orderkey % 5 = 0 THEN 0.0 ELSE 30.0 END AS nominal, l_orderkey % 7 = 0 AS implicit FROM lineitem GROUP BY l_suppkey, l_orderkey),
e AS (SELECT *, min(l_orderkey) OVER w AS lo, max(l_orderkey) OVER w AS hi FROM m WINDOW w AS (PARTITION BY l_suppkey))
SELECT l_suppkey, l_orderkey, round(held, 3) AS held, round(nominal, 3)::DOUBLE AS expected FROM e WHERE nominal > 0 AND held > 0 AND abs(held - nominal) > 1e-3 AND NOT (l_orderkey IN (lo, hi) AND held < nominal) AND NOT implicit
""")
def odd_measures(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_quantity").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("held"))
    m = m.withColumn("nominal", F.when(F.col("l_orderkey") % 5 == 0, 0.0).otherwise(30.0))
    return Q.odd_measures(m, ["l_suppkey"], "l_orderkey", "held", "nominal", F.col("l_orderkey") % 7 == 0)


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber % 2 AS voice, l_linenumber AS p, CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS n, l_returnflag = 'N' AS rest FROM lineitem),
e AS (SELECT *, p + n AS stop, max(p + n) OVER (PARTITION BY l_orderkey) AS top, lag(p + n) OVER (PARTITION BY l_orderkey, voice ORDER BY p) AS before FROM n)
SELECT l_orderkey, voice, max(stop)::BIGINT AS stop FROM e GROUP BY l_orderkey, voice HAVING max(top) = 6 AND max(stop) < 6 AND bool_and(before IS NULL OR before = p) AND NOT bool_and(rest)
""")
def short_voices(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    n = n.select("l_orderkey", (F.col("l_linenumber") % 2).alias("voice"), F.col("l_linenumber").alias("at"), F.when(F.col("l_quantity") > 25, 2).otherwise(1).alias("len"), (F.col("l_returnflag") == "N").alias("rest"))
    return Q.short_voices(n, ["l_orderkey"], ["voice"], "at", "len", "rest", F.lit(6)).select("l_orderkey", "voice", F.col("stop").cast("long").alias("stop"))


@query("""
WITH w AS (SELECT l_suppkey, l_linenumber, count(*) AS written FROM lineitem GROUP BY ALL), e AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL)
SELECT l_suppkey, l_linenumber, n FROM e JOIN w USING (l_suppkey, l_linenumber) WHERE n / written >= 0.7
""")
def systematic_kinds(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_discount")
    l = l.withColumn("written", F.count("*").over(Window.partitionBy("l_suppkey", "l_linenumber")))
    return Q.systematic(l.where("l_discount > 0.02"), ["l_suppkey"], ["l_linenumber"], "written")


@query(f"""
WITH {_E}, s AS (SELECT user_id, day, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 9) AS err FROM e GROUP BY user_id, day), b AS (SELECT *, err >= 0.3 AS bad FROM s),
o AS (SELECT *, coalesce(avg(CASE WHEN NOT bad THEN err END) OVER (PARTITION BY user_id), 0) AS rest, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day) AS turn FROM b)
SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM o WHERE bad AND rest < 0.2 GROUP BY user_id, turn HAVING count(*) >= 2
""")
def bad_regions(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).groupBy("user_id", "day").agg(F.round(F.avg(F.when(F.col("value") > 100, 1.0).otherwise(0.0)), 9).alias("err"))
    return Q.regions(s, ["user_id"], "day", "err", bad=0.3, rest=0.2)


@query("""
WITH c AS (SELECT l_orderkey, l_partkey % 6 AS k, count(*) FILTER (WHERE l_returnflag <> 'R') AS a, count(*) FILTER (WHERE l_returnflag <> 'A') AS b FROM lineitem GROUP BY ALL),
n AS (SELECT l_orderkey, l_linenumber, ([ 'missed', 'wrong', 'extra'])[1 + l_linenumber % 3] AS kind, l_partkey % 6 AS w, l_suppkey % 6 AS p, l_discount * 10 AS doubt, l_orderkey % 5 <> 0 AS read FROM lineitem),
j AS (SELECT n.*, coalesce(x.a, 0) AS wa, coalesce(x.b, 0) AS wb, coalesce(y.a, 0) AS pa, coalesce(y.b, 0) AS pb FROM n LEFT JOIN c x ON x.l_orderkey = n.l_orderkey AND x.k = w LEFT JOIN c y ON y.l_orderkey = n.l_orderkey AND y.k = p),
r AS (SELECT *, CASE WHEN NOT read THEN NULL WHEN kind IN ('missed', 'wrong') AND wb >= wa THEN 'confirmed' WHEN kind = 'extra' AND pb <= pa THEN 'confirmed' WHEN kind = 'missed' THEN 'contradicted' WHEN pb > pa THEN 'contradicted' END AS reason FROM j)
SELECT l_orderkey, l_linenumber, reason, round(CASE reason WHEN 'confirmed' THEN doubt * 0.2 WHEN 'contradicted' THEN greatest(doubt, 0.7) ELSE doubt END, 6) AS doubt FROM r
""")
def note_doubts(spark: SparkSession, d: str) -> DataFrame:
    """Disagreements with a take, weighed by what a second reading of the same measure has."""
    l = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    c = l.groupBy("l_orderkey", (F.col("l_partkey") % 6).alias("k")).agg(F.count_if(F.col("l_returnflag") != "R").alias("a"), F.count_if(F.col("l_returnflag") != "A").alias("b"))
    kind = F.element_at(F.array(F.lit("missed"), F.lit("wrong"), F.lit("extra")), F.col("l_linenumber") % 3 + 1)
    n = l.select("l_orderkey", "l_linenumber", kind.alias("kind"), (F.col("l_partkey") % 6).alias("w"), (F.col("l_suppkey") % 6).alias("p"), (F.col("l_discount") * 10).alias("doubt"), (F.col("l_orderkey") % 5 != 0).alias("read"))
    counts = lambda name: c.select("l_orderkey", F.col("k").alias(name), F.col("a").alias(f"{name}a"), F.col("b").alias(f"{name}b"))
    j = n.join(counts("w"), ["l_orderkey", "w"], "left").join(counts("p"), ["l_orderkey", "p"], "left").fillna(0, ["wa", "wb", "pa", "pb"])
    held = j.withColumn("n", Q.note_doubt(F.col("doubt"), F.col("kind"), F.col("read"), (F.col("wa"), F.col("wb")), (F.col("pa"), F.col("pb"))))
    return held.select("l_orderkey", "l_linenumber", "n.reason", F.round("n.doubt", 6).alias("doubt"))


@query("SELECT l_orderkey, l_linenumber, l_tax * 10 < 0.5 AS scored, CASE WHEN l_tax * 10 < 0.5 THEN round(1.0 - l_tax * 10, 6) ELSE 0.0 END AS trust FROM lineitem")
def doubt_exclusion(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_tax").withColumn("doubt", F.col("l_tax") * 10)
    return Q.doubtful(l, "doubt").select("l_orderkey", "l_linenumber", "scored", F.round("trust", 6).alias("trust"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) / 1e6 AS start, epoch_us(o_orderdate) / 1e6 + (o_orderkey % 90) * 86400.0 AS stop, lag(epoch_us(o_orderdate) / 1e6 + (o_orderkey % 90) * 86400.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey, bool_and(stop > start AND start >= 0 AND (before IS NULL OR start >= before - 1e-6)) AS valid FROM s GROUP BY o_custkey
""")
def timeline_intervals(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate").withColumn("start", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6))
    o = o.withColumns({"stop": F.col("start") + (F.col("o_orderkey") % 90) * 86400.0, "seq": F.struct("o_orderdate", "o_orderkey")})
    return Q.valid_timeline(o, ["o_custkey"], "seq")


@query(f"""
WITH {_E}, m AS (SELECT user_id, day AS measure, min(t) - 1704067200 AS p FROM e GROUP BY user_id, day), k AS (SELECT *, measure - lag(measure) OVER w AS step, lag(p) OVER w AS before FROM m WINDOW w AS (PARTITION BY user_id ORDER BY measure))
SELECT user_id, bool_and((step IS NULL OR step = 1) AND (before IS NULL OR p > before) AND p BETWEEN 0 AND 2592000) AS valid, count(*) AS markers FROM k GROUP BY user_id
""")
def sync_markers(spark: SparkSession, d: str) -> DataFrame:
    m = events(spark, d).groupBy("user_id", F.col("day").alias("measure")).agg((F.min("t") - 1704067200).alias("at"))
    return Q.valid_markers(m, ["user_id"], "measure", "at", 2592000.0)


# Matching.


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as intervals of two hours that don't nest, labelled by their ids."""
    e = events(spark, d).where("event_type = 'purchase'")
    w = Window.partitionBy("user_id").orderBy("t")
    return e.select("user_id", F.col("t").alias("start"), F.least(F.col("t") + 7200.0, F.coalesce(F.lead("t").over(w), F.col("t") + 7200.0)).alias("stop"), F.col("event_id").alias("label"))


_INTERVALS = _E + ", i AS (SELECT user_id, t AS start, least(t + 7200.0, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), t + 7200.0)) AS stop, event_id AS label FROM e WHERE event_type = 'purchase')"


@query(f"""
WITH {_INTERVALS}, p AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'view'),
c AS (SELECT event_id, label, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN t >= start AND t < stop THEN 0 ELSE 1 END, CASE WHEN t >= start AND t < stop THEN -start ELSE abs((start + stop) / 2 - t) END, start, label) AS r FROM p LEFT JOIN i USING (user_id))
SELECT event_id, label FROM c WHERE r = 1
""")
def interval_labels(spark: SparkSession, d: str) -> DataFrame:
    """The interval that a point is in, or else the one whose middle is nearest."""
    p = events(spark, d).where("event_type = 'view'").select("event_id", "user_id", "t")
    return M.containing(p, _intervals(spark, d), ["user_id"], "t", "label", nearest_middle=True).select("event_id", "label")


@query(f"""
WITH {_INTERVALS}, f AS (SELECT event_id, user_id, t, CASE WHEN event_id % 4 > 0 THEN value END AS own, (event_id % 10) / 10.0 AS trust FROM e WHERE event_type <> 'purchase'),
h AS (SELECT f.*, label FROM f LEFT JOIN i ON f.user_id = i.user_id AND f.t >= i.start AND f.t < i.stop)
SELECT event_id, CASE WHEN own IS NOT NULL AND trust >= 0.7 THEN own ELSE label END::DOUBLE AS pitch, CASE WHEN own IS NOT NULL AND trust >= 0.7 THEN trust WHEN label IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM h
""")
def fused_track(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d).where("event_type <> 'purchase'").select("event_id", "user_id", "t", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("own"), ((F.col("event_id") % 10) / 10.0).alias("trust"))
    notes = _intervals(spark, d).withColumn("note", F.col("label").cast("double")).drop("label")
    return M.fused(f, notes, ["user_id"], "t", "own", "trust").select("event_id", "pitch", "confidence")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey AS id, epoch_us(o_orderdate) / 86400e6 AS start, epoch_us(o_orderdate) / 86400e6 + o_orderkey % 60 + 1 AS stop FROM orders), l AS (SELECT * FROM s WHERE id % 2 = 0), r AS (SELECT * FROM s WHERE id % 2 = 1)
SELECT l.o_custkey, l.id AS left_id, r.id AS right_id, round(greatest(0.0, least(l.stop, r.stop) - greatest(l.start, r.start)), 6) AS overlap FROM l JOIN r ON l.o_custkey = r.o_custkey
QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY CASE WHEN l.start < r.stop AND r.start < l.stop THEN least(l.stop, r.stop) - greatest(l.start, r.start) ELSE 0 END DESC, abs(l.start - r.start), CASE WHEN l.start < r.stop AND r.start < l.stop THEN 0 ELSE r.start END, r.id) = 1
""")
def overlap_or_nearest(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    s = s.select("o_custkey", F.col("o_orderkey").alias("id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400e6).alias("start")).withColumn("stop", F.col("start") + F.col("id") % 60 + 1)
    found = M.overlap_or_nearest(s.where("id % 2 = 0"), s.where("id % 2 = 1"), ["o_custkey"], 60.0)
    return found.select("o_custkey", "left_id", "right_id", F.round("overlap", 6).alias("overlap"))


@query(f"""
WITH {_ERRORS}, v AS (SELECT user_id, round(err / 1000 + CASE WHEN user_id % 2 = 0 THEN 0.2 ELSE 0 END, 6) AS e FROM x), f AS (SELECT user_id, round(k * 0.02, 6) AS o, median(abs(e - round(k * 0.02, 6))) AS r FROM v, generate_series(-25, 25) g(k) GROUP BY user_id, k),
b AS (SELECT user_id, o, r, min(CASE WHEN o = 0 THEN r END) OVER (PARTITION BY user_id) AS flat, row_number() OVER (PARTITION BY user_id ORDER BY r, abs(o), o) AS i FROM f)
SELECT user_id, CASE WHEN flat - r >= 0.015 THEN o ELSE 0.0 END::DOUBLE AS "offset", round(CASE WHEN flat - r >= 0.015 THEN r ELSE flat END, 6) AS residual FROM b WHERE i = 1
""")
def common_offset(spark: SparkSession, d: str) -> DataFrame:
    v = _errors(spark, d).select("user_id", F.round(F.col("err") / 1000 + F.when(F.col("user_id") % 2 == 0, 0.2).otherwise(0), 6).alias("e"))
    return P.offset_search(v, ["user_id"], "e").select("user_id", "offset", F.round("residual", 6).alias("residual"))


@query(f"""
WITH {_E}, q AS (SELECT user_id, event_type AS reading, round(avg(value), 9) AS quality FROM e GROUP BY ALL),
b AS (SELECT user_id, max(struct_pack(q := quality, r := reading)) AS b, max(CASE WHEN reading = 'view' THEN quality END) AS own FROM q GROUP BY user_id)
SELECT user_id, CASE WHEN own IS NOT NULL AND b.q < own * 1.3 THEN 'view' ELSE b.r END AS reading, CASE WHEN own IS NOT NULL AND b.q < own * 1.3 THEN own ELSE b.q END AS quality FROM b
""")
def best_reading(spark: SparkSession, d: str) -> DataFrame:
    q = events(spark, d).groupBy("user_id", F.col("event_type").alias("reading")).agg(F.round(F.avg("value"), 9).alias("quality"))
    return P.best_reading(q, ["user_id"], "reading", "quality", "view")


@query(f"""
WITH {_E}, p AS (SELECT user_id, list([struct_pack(t := t, v := value)] ORDER BY value, t) AS ps FROM e WHERE value IS NOT NULL GROUP BY user_id),
k AS (SELECT user_id, unnest(list_reduce(ps, lambda a, x: CASE WHEN len(a) < 3 AND len(list_filter(a, lambda y: abs(y.t - x[1].t) < 86400 - 1e-9)) = 0 THEN list_concat(a, x) ELSE a END)) AS u FROM p)
SELECT user_id, round(u.t, 6) AS t, u.v AS value FROM k
""")
def spaced_candidates(spark: SparkSession, d: str) -> DataFrame:
    return P.spaced_best(events(spark, d).where("value IS NOT NULL"), ["user_id"], "t", "value", 86400.0).select("user_id", F.round("t", 6).alias("t"), "value")


@query(f"""
WITH {_E}, n AS (SELECT user_id, event_id AS id, (event_id % 40 + 40)::DOUBLE AS target, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN value * 20 ELSE value END AS own, t - 200000.0 AS lo, t + 200000.0 AS hi, event_id % 2 = 0 AS weak FROM e WHERE event_type = 'purchase'),
f AS (SELECT user_id, t, (event_id % 40 + 40)::DOUBLE AS midi FROM e WHERE event_type = 'view' AND (event_id % 10) / 10.0 >= 0.5),
m AS (SELECT n.user_id, id, median(midi) AS m FROM n JOIN f ON n.user_id = f.user_id AND t BETWEEN lo AND hi GROUP BY n.user_id, id HAVING count(*) >= 4),
s AS (SELECT n.*, round((m - target) * 100, 1) AS second FROM n LEFT JOIN m USING (user_id, id)),
k AS (SELECT *, CASE WHEN own IS NULL AND second IS NOT NULL AND NOT (weak AND abs(second) > 200) THEN 'filled' WHEN own IS NOT NULL AND abs(own) > 1000 AND second IS NOT NULL THEN 'replaced' WHEN own IS NOT NULL THEN 'own' ELSE 'none' END AS source FROM s)
SELECT id AS event_id, second, CASE WHEN source IN ('filled', 'replaced') THEN second ELSE own END AS cents, source FROM k
""")
def second_opinions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    e = events(spark, d).withColumn("midi", (i % 40 + 40).cast("double"))
    notes = e.where("event_type = 'purchase'").select("user_id", i.alias("id"), F.col("midi").alias("target"), F.when(i % 3 == 1, F.col("value") * 20).when(i % 3 == 2, F.col("value")).alias("cents"), (F.col("t") - 200000.0).alias("lo"), (F.col("t") + 200000.0).alias("hi"), (i % 2 == 0).alias("weak"))
    frames = e.where("event_type = 'view'").select("user_id", "t", "midi", ((i % 10) / 10.0).alias("voicing"))
    return R.second_opinion(notes, frames, ["user_id"], width=200000.0).select(F.col("id").alias("event_id"), "second", "cents", "source")


@query()
def two_stage_offset(spark: SparkSession, d: str) -> DataFrame:
    """How far each user's clicks lie off the grid of their views; the second stage steps from the best so far."""
    e = events(spark, d).select("user_id", "event_type", (F.col("t") - 1704067200.0).alias("t"))
    return M.two_stage_offset(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"], 3600.0)


def _notes(spark: SparkSession, d: str, kind: str) -> DataFrame:
    e = events(spark, d).where(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias("id"), (F.col("event_id") % 24 + 48).alias("midi"), (F.col("t") / 3600).alias("t"))


@query()
def same_pitch_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.same_pitch(_notes(spark, d, "view"), _notes(spark, d, "click"), ["user_id"], 24.0)


@query()
def wrong_note_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.wrong_notes(_notes(spark, d, "view"), _notes(spark, d, "click"), ["user_id"], 24.0)


@query()
def octave_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.octave_conflicts(_notes(spark, d, "view"), _notes(spark, d, "click"), ["user_id"], 12.0)


# Stored results and sessions.


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE o_orderstatus END AS status FROM orders
""")
def verified_results(spark: SparkSession, d: str) -> DataFrame:
    """Results whose stored checksum isn't theirs any more fail when they are read: here every tenth was changed."""
    o = load(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").withColumn("result", F.struct("o_custkey", "o_totalprice"))
    stored = S.sealed(o, "result").withColumn("result", F.struct(F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_totalprice"))
    return S.verified(stored, "result", "o_orderstatus").select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)")
def erased_accounts(spark: SparkSession, d: str) -> DataFrame:
    gone = load(spark, d, "customer", "c_custkey").where("c_custkey % 7 = 0").withColumnRenamed("c_custkey", "o_custkey")
    return S.erased(load(spark, d, "orders", "o_orderkey", "o_custkey"), gone, "o_custkey")


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(n, 0) AS orders, c_mktsegment AS segment FROM customer LEFT JOIN o ON o_custkey = c_custkey
""")
def exported_accounts(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document a customer, read back: how many orders it holds, and the customer's segment."""
    o = load(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").withColumnRenamed("o_custkey", "c_custkey")
    made = S.export(load(spark, d, "customer", "c_custkey", "c_mktsegment"), {"orders": o}, "c_custkey")
    back = F.from_json("document", "c_mktsegment string, orders array<struct<o_orderkey:bigint,o_totalprice:double>>")
    return made.withColumn("b", back).select("c_custkey", F.coalesce(F.size("b.orders"), F.lit(0)).cast("long").alias("orders"), F.col("b.c_mktsegment").alias("segment"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE o_orderstatus END AS status FROM orders
""")
def recovered_jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "succeeded").otherwise(F.col("o_orderstatus"))
    return S.recovered(load(spark, d, "orders", "o_orderkey", "o_orderstatus").withColumn("status", status)).select("o_orderkey", "status")


@query(f"""
WITH {_E}, l AS (SELECT user_id, list([struct_pack(id := event_id, t := t, ok := true, x := t + 172800.0)] ORDER BY t, event_id) AS xs FROM e GROUP BY user_id),
g AS (SELECT user_id, unnest(list_reduce(xs, lambda a, n: list_concat(a, [struct_pack(id := n[1].id, t := n[1].t, ok := a[-1].x >= n[1].t, x := CASE WHEN a[-1].x >= n[1].t AND a[-1].x - n[1].t < 172800.0 - 86400.0 THEN n[1].t + 172800.0 ELSE a[-1].x END)]))) AS u FROM l)
SELECT u.id AS event_id, u.ok AS valid, round(u.x, 6) AS expires FROM g
""")
def rolling_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = ST.rolling_sessions(events(spark, d), "user_id", "t", "event_id", 172800.0, 86400.0)
    return s.select("event_id", "valid", F.round("expires", 6).alias("expires"))


@query(f"""
WITH {_E}, c AS (SELECT event_id, user_id, day, t, event_type = 'purchase' AS hit, value * 10 AS age FROM e),
w AS (SELECT *, coalesce(sum(CASE WHEN hit OR age > 600 THEN 0 ELSE 1 END) OVER p, 0) AS wrong FROM c WINDOW p AS (PARTITION BY user_id, day ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, hit AND age <= 600 AND wrong < 2 AS good FROM w)
SELECT event_id, good AND NOT coalesce(bool_or(good) OVER (PARTITION BY user_id, day ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS accepted FROM g
""")
def codes_checked(spark: SparkSession, d: str) -> DataFrame:
    return ST.codes_checked(events(spark, d), ["user_id", "day"], ["t", "event_id"], F.col("event_type") == "purchase", F.col("value") * 10, attempts=2).select("event_id", "accepted")
