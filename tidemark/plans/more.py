"""More registered queries: ordering, lookups, set operations, sequences, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import alignment as L
from tidemark.operators import excerpts as EX
from tidemark.operators import matching as M
from tidemark.operators import quality as Q
from tidemark.operators import store as S
from tidemark.operators import windows as W
from tidemark.plans.catalog import _DEV, _E, _deviations, query
from tidemark.session import dealt, parts
from tidemark.sources.tables import events, load
from tidemark.streaming import stateful as ST


@query(f"WITH {_E} SELECT event_id, row_number() OVER w AS attempt, lag(event_id) OVER w AS retries FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)")
def retry_lineage(spark: SparkSession, d: str) -> DataFrame:
    return W.lineage(events(spark, d), "user_id", ["t", "event_id"], "event_id").select("event_id", "attempt", "retries")


@query(f"WITH {_E} SELECT event_id, CASE WHEN event_type <> 'error' THEN sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT END AS number FROM e")
def renumber_skips(spark: SparkSession, d: str) -> DataFrame:
    return W.renumber(events(spark, d), ["user_id"], "event_id", F.col("event_type") == "error").select("event_id", "number")


@query(f"""
WITH {_E}, n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)::DOUBLE AS i, value FROM e),
s AS (SELECT event_id, CASE WHEN count(value) OVER w >= 2 THEN regr_slope(value, i) OVER w END AS slope FROM n WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN slope IS NOT NULL THEN round(least(5.0, greatest(-5.0, slope)), 6) END AS trend FROM s
""")
def trailing_trend(spark: SparkSession, d: str) -> DataFrame:
    n = events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("double"))
    return W.trailing_trend(n, ["user_id"], "i", "value", 8, 5.0).select("event_id", F.round("trend", 6).alias("trend"))


@query("SELECT url, page_id FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1 ORDER BY page_id DESC LIMIT 500")
def catalogue_latest(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue report: one entry a path, the newest 500."""
    p = load(spark, d, "pages", "url", "page_id")
    return p.groupBy("url").agg(F.max("page_id").alias("page_id")).orderBy(F.desc("page_id")).limit(500).select("url", "page_id")


@query("""
WITH r AS (SELECT sha256(text) AS k, max(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT doc_id, quality FROM documents LEFT JOIN r ON k = sha256(text)
""")
def second_reading_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Results known for a content, looked up by its address."""
    docs = load(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("k"))
    known = docs.join(load(spark, d, "labels", "doc_id", "quality"), "doc_id").groupBy("k").agg(F.max("quality").alias("quality"))
    return docs.join(known, "k", "left").select("doc_id", "quality")


@query(f"""
WITH {_E}, n AS (SELECT event_id, user_id, t, CAST(value AS INTEGER) % 48 AS p FROM e WHERE value IS NOT NULL)
SELECT event_id, EXISTS (SELECT 1 FROM n b WHERE b.user_id = n.user_id AND n.p - b.p IN (12, 19, 24) AND abs(b.t - n.t) <= 3600) AS masked FROM n
""")
def overtone_mask(spark: SparkSession, d: str) -> DataFrame:
    n = events(spark, d).where("value IS NOT NULL").select("event_id", "user_id", "t", (F.rint("value").cast("int") % 48).alias("p"))
    return M.masked_by_lower(n, ["user_id"], "t", "p", 3600.0).select("event_id", "masked")


#: Pairs of a point and a rectangle that one block of a cell holds.
HITS = 1 << 22


@query("""
SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size BETWEEN s_nationkey * 2 AND s_nationkey * 2 + 1 AND p_retailprice BETWEEN 900 + s_acctbal / 20 AND 1500 + s_acctbal / 20
""")
def hit_test(spark: SparkSession, d: str) -> DataFrame:
    """Points in rectangles: the side of one axis is an equality, the other a condition.

    A cell's points times its rectangles grow with the square of the tables. So
    both are dealt out to blocks of about ``HITS`` such pairs, each a part of a
    cell's points with all of its rectangles, whatever the cells' sizes.
    """
    s = load(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").withColumn("cell", F.explode(F.array(F.col("s_nationkey") * 2, F.col("s_nationkey") * 2 + 1)))
    p = load(spark, d, "part", "p_partkey", "p_size", "p_retailprice").withColumn("cell", F.col("p_size"))
    # One row a cell; there are as many as sizes, whatever the tables'.
    cells = F.broadcast(p.groupBy("cell").agg(F.count("*").alias("_p")).join(s.groupBy("cell").agg(F.count("*").alias("_s")), "cell").select("cell", F.ceil(F.col("_p") * F.col("_s") / HITS).cast("int").alias("_blocks")))
    p = p.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("p_partkey"), F.col("_blocks")).cast("int")).repartition(parts(spark), "cell", "block")
    s = s.join(cells, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).repartition(parts(spark), "cell", "block")
    inside = F.col("p_retailprice").between(900 + F.col("s_acctbal") / 20, 1500 + F.col("s_acctbal") / 20)
    return p.join(s.hint("shuffle_hash"), ["cell", "block"]).where(inside).select("p_partkey", "s_suppkey")


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, coalesce(CASE c_nationkey WHEN 3 THEN 'override' END, r_name, 'none') AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def override_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer", "c_custkey", "c_nationkey")
    n = load(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").join(load(spark, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    meters = F.map_from_arrays(F.array(F.lit(3)), F.array(F.lit("override")))
    both = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return both.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce(meters[F.col("c_nationkey")], "r_name", F.lit("none")).alias("region"))


@query("SELECT l_partkey, l_suppkey, l_extendedprice AS cost FROM lineitem QUALIFY l_extendedprice <= min(l_extendedprice) OVER (PARTITION BY l_partkey) * 1.4 AND row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) <= 16")
def candidate_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Candidates within a margin of the best, 16 at most."""
    return _cutoff(load(spark, d, "lineitem"))


def _cutoff(l: DataFrame) -> DataFrame:
    w = Window.partitionBy("l_partkey")
    near = l.withColumns({"best": F.min("l_extendedprice").over(w), "r": F.row_number().over(w.orderBy("l_extendedprice", "l_orderkey", "l_linenumber"))})
    return near.where((F.col("l_extendedprice") <= F.col("best") * 1.4) & (F.col("r") <= 16)).select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("cost"))


@query("SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_quantity > 48 EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_discount", "l_quantity")
    s = load(spark, d, "supplier", "s_suppkey", "s_acctbal")
    return l.where("l_returnflag = 'R' AND l_discount > 0.08").select("l_suppkey").intersect(l.where("l_quantity > 48").select("l_suppkey")).subtract(s.where("s_acctbal < 0").select("s_suppkey"))


@query("SELECT l_partkey % 20 AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT ALL SELECT l_partkey % 20 FROM lineitem WHERE l_returnflag = 'R'")
def multiset_intersection(spark: SparkSession, d: str) -> DataFrame:
    l = load(spark, d, "lineitem", "l_partkey", "l_returnflag").withColumn("k", F.col("l_partkey") % 20)
    return l.where("l_returnflag = 'A'").select("k").intersectAll(l.where("l_returnflag = 'R'").select("k"))


@query(f"WITH {_E} SELECT user_id, round(atan2(sum(value * sin(t * 2 * pi() / 86400)), sum(value * cos(t * 2 * pi() / 86400))), 6) AS direction, round(sqrt(sum(value * sin(t * 2 * pi() / 86400)) ** 2 + sum(value * cos(t * 2 * pi() / 86400)) ** 2) / sum(value), 6) AS concentration FROM e GROUP BY user_id")
def circular_mean(spark: SparkSession, d: str) -> DataFrame:
    direction, concentration = A.circular_mean(F.col("t") * 2 * F.pi() / 86400, F.col("value"))
    return events(spark, d).groupBy("user_id").agg(F.round(direction, 6).alias("direction"), F.round(concentration, 6).alias("concentration"))


@query(f"WITH {_E} SELECT user_id, list_sort(list(value))[count(value) // 2 + 1] AS middle FROM e WHERE value IS NOT NULL GROUP BY user_id")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("value IS NOT NULL").groupBy("user_id").agg(A.upper_median(F.col("value")).alias("middle"))


@query(f"WITH {_E}, g AS (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) AS gap FROM e) SELECT event_type, count(gap) AS n, round(median(gap), 6) AS median, CASE WHEN count(gap) >= 3 THEN round(stddev_pop(gap) / avg(gap), 6) END AS variation FROM g GROUP BY event_type")
def tempo_variation(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("event_type").orderBy("t", "event_id")))
    return A.variation(g, ["event_type"], "gap")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS onset, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS members, count(*) AS size FROM orders GROUP BY 1")
def chord_groups(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("day", F.unix_date(F.col("o_orderdate").cast("date")).cast("double"))
    made = A.chords(o, [], "day", "o_orderkey")
    return made.select(F.date_format(F.date_from_unix_date(F.col("onset").cast("int")), "yyyy-MM-dd").alias("onset"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "size")


@query(f"WITH {_DEV}, s AS (SELECT user_id, avg(CASE WHEN abs(dev) > 100 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS b FROM dev GROUP BY user_id) SELECT user_id, round(1 - (1 - a) * (1 - b), 9) AS doubt FROM s")
def noisy_or_doubt(spark: SparkSession, d: str) -> DataFrame:
    s = _deviations(spark, d).groupBy("user_id").agg(F.avg(F.when(F.abs("dev") > 100, 1.0).otherwise(0.0)).alias("a"), F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("b"))
    return s.select("user_id", F.round(A.noisy_or(F.col("a"), F.col("b")), 9).alias("doubt"))


@query(f"""
WITH {_E}, d AS (SELECT DISTINCT user_id, day FROM e), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM d),
r AS (SELECT user_id, k, min(day) AS lo, max(day) AS hi FROM g GROUP BY user_id, k)
SELECT user_id, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS days FROM r GROUP BY user_id
""")
def range_text(spark: SparkSession, d: str) -> DataFrame:
    days = events(spark, d).select("user_id", "day").distinct().groupBy("user_id").agg(F.collect_list("day").alias("days"))
    return days.select("user_id", W.range_text(F.col("days")).alias("days"))


@query(f"""
WITH {_E}, s AS (SELECT user_id, avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END) AS excluded, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS bad, count(value) / count(*) AS cov, count(*) / 2.0 AS tempo FROM e GROUP BY user_id)
SELECT user_id, concat_ws(',', CASE WHEN excluded > 0.3 THEN 'too_many_excluded' END, CASE WHEN bad > 0.25 THEN 'measure_length' END, CASE WHEN cov < 0.3 THEN 'low_coverage' END, CASE WHEN tempo NOT BETWEEN 15 AND 360 THEN 'tempo_implausible' END) AS refused FROM s
""")
def refusal_gates(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    s = e.groupBy("user_id").agg(F.avg(F.when(F.col("value") < 20, 1.0).otherwise(0.0)).alias("excluded"), F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("bad_measures"), (F.count("value") / F.count("*")).alias("coverage"), (F.count("*") / 2.0).alias("tempo"))
    return Q.refusals(s).select("user_id", F.array_join("refused", ",").alias("refused"))


@query(f"WITH {_E} SELECT user_id, beat, round(start + beat * 1.5, 3) AS \"at\" FROM (SELECT user_id, min(t) AS start FROM e GROUP BY user_id), generate_series(0, 31) s(beat)")
def beat_schedule(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).groupBy("user_id").agg(F.min("t").alias("start")).withColumns({"spb": F.lit(1.5), "beats": F.lit(32).cast("long")})
    return ST.schedule(s, "start", "spb", "beats").select("user_id", F.col("beat").cast("long").alias("beat"), F.round("at", 3).alias("at"))


@query("""
WITH n AS (SELECT doc_id, n_chars, greatest(1, ceil(n_chars / 2400.0))::BIGINT AS parts FROM documents)
SELECT doc_id, k::INTEGER AS k, round(n_chars::DOUBLE * k / parts, 6) AS lo, round(n_chars::DOUBLE * (k + 1) / parts, 6) AS hi FROM (SELECT *, unnest(generate_series(0, parts - 1)) AS k FROM n)
""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "documents", "doc_id", "n_chars").withColumn("n_chars", F.col("n_chars").cast("double"))
    return ST.chunks(n, "n_chars", 2400.0).select("doc_id", F.col("k").cast("int").alias("k"), F.round("from", 6).alias("lo"), F.round("to", 6).alias("hi"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 10")
def retention(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate").withColumn("o", F.struct("o_orderdate", "o_orderkey"))
    return S.newest(o, ["o_custkey"], "o", 10).select("o_custkey", "o_orderkey")


#: Cells of a row of the longest common subsequence with the template, each from the one before it and the row above.
_LCS: list[str] = []
for _j, _x in enumerate(("view", "click", "view", "click", "purchase"), 1):
    _corner = f"a.r[{_j - 1}] + 1" if _j > 1 else "1"
    _LCS.append(f"CASE WHEN x.e = '{_x}' THEN {_corner} ELSE greatest(a.r[{_j}], {_LCS[-1] if _LCS else 0}) END")


@query(f"""
WITH {_E}, s AS (SELECT user_id, list(struct_pack(e := event_type, r := [0, 0, 0, 0, 0]) ORDER BY t, event_id) AS xs FROM e GROUP BY user_id)
SELECT user_id, list_reduce(list_prepend(struct_pack(e := '', r := [0, 0, 0, 0, 0]), xs), lambda a, x: struct_pack(e := x.e, r := [{", ".join(_LCS)}])).r[5] AS matched FROM s
""")
def lcs_opening(spark: SparkSession, d: str) -> DataFrame:
    """How much of a template each user's events follow, in order."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    whole = events(spark, d).withColumn("i", F.row_number().over(w)).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "event_type"))), lambda s: s["event_type"]).alias("seen"))
    template = F.array(*(F.lit(x) for x in ("view", "click", "view", "click", "purchase")))
    return whole.select("user_id", L.lcs_length(F.col("seen"), template).alias("matched"))


@query()
def edit_align(spark: SparkSession, d: str) -> DataFrame:
    """Alignment of each week of a user's events with the same user's next week, by value."""
    e = events(spark, d).withColumns({"k": F.col("event_id"), "p": 36 + F.col("value") % 60})
    first = F.min("day").over(Window.partitionBy("user_id"))
    e = e.withColumn("week", F.floor((F.col("day") - first) / 7))
    later = e.withColumn("week", F.col("week") - 1)
    return L.align(e, later, ["user_id", "week"], "k", "p").drop("week")


@query()
def locate_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """Where among all of a user's events the twelve from the 11th on fit."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, d).select("user_id", F.row_number().over(w).alias("k"), (36 + F.col("value") % 60).alias("p"))
    return EX.locate(e.where("k BETWEEN 11 AND 22"), e, ["user_id"], "k", "p")


def _played(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A line of all of a user's events, a beat each, and a take of its middle third at 0.4 s a beat, with notes left out, an octave low and late."""
    w = Window.partitionBy("user_id")
    e = events(spark, d).select("user_id", "event_id", F.row_number().over(w.orderBy("t", "event_id")).alias("k"), F.count("*").over(w).alias("n"), (40 + F.col("value") % 48).alias("pitch"))
    line = e.select("user_id", (F.col("k") - 1).cast("double").alias("beat"), F.lit(1.0).alias("length"), F.floor((F.col("k") - 1) / 4).alias("measure"), "pitch")
    third = e.where((F.col("k") > F.col("n") / 3) & (F.col("k") <= 2 * F.col("n") / 3) & (F.col("event_id") % 11 > 0))
    at = (F.col("k") - F.floor(F.col("n") / 3)) * 0.4 + F.col("event_id") % 7 * 0.005
    return third.select("user_id", at.alias("start"), (at + 0.3).alias("stop"), (F.col("pitch") - F.when(F.col("event_id") % 13 == 0, 12).otherwise(0)).alias("pitch")), line


@query()
def excerpt_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Where each user's take lies in the line of all of their events, whole: both ends, tempo, measures, or why it is refused."""
    heard, line = _played(spark, d)
    found = EX.align_excerpt(heard, line, ["user_id"])
    return found.withColumn("measures", F.size("measures"))


@query()
def dtw_documents(spark: SparkSession, d: str) -> DataFrame:
    """Cost of warping a conversation's user turns onto the assistant's, as bags of words."""
    from tidemark.session import ready

    ready(spark)
    turns = load(spark, d, "conversations", "conv_id", "turn", "role", "text")

    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values("turn")
        a, b = ([(t or "").lower().split() for t in pdf["text"][(pdf["role"] == "user") == own]] for own in (True, False))
        return pd.DataFrame([(int(pdf["conv_id"].iloc[0]), round(L.dtw_cost(a, b), 6))], columns=["conv_id", "cost"])

    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").applyInPandas(fold, "conv_id long, cost double")


#: What may follow a state, as SQL.
_NEXT = "CASE a.s " + " ".join(f"WHEN '{state}' THEN {after}" for state, after in ST.TRANSITIONS.items()) + " END"


@query(f"""
WITH {_E}, s AS (SELECT user_id, list(struct_pack(s := CASE event_type WHEN 'view' THEN 'validating' WHEN 'click' THEN 'preparing' WHEN 'purchase' THEN 'submitting' WHEN 'signup' THEN 'polling' WHEN 'error' THEN 'failed' ELSE 'cancelled' END, n := 0) ORDER BY t, event_id) AS xs FROM e GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_prepend(struct_pack(s := 'idle', n := 0), xs), lambda a, x: CASE WHEN list_contains({_NEXT}, x.s) THEN struct_pack(s := x.s, n := a.n) ELSE struct_pack(s := a.s, n := a.n + 1) END) AS r FROM s)
SELECT user_id, r.s AS state, 0::BIGINT AS generation, r.n::BIGINT AS rejected FROM r
""")
def job_state_fold(spark: SparkSession, d: str) -> DataFrame:
    steps = F.create_map(*(F.lit(v) for pair in {"view": "validating", "click": "preparing", "purchase": "submitting", "signup": "polling", "error": "failed"}.items() for v in pair))
    e = events(spark, d).select("user_id", "t", "event_id", (F.col("day") * 0).cast("long").alias("generation"), F.coalesce(steps[F.col("event_type")], F.lit("cancelled")).alias("action"))
    return ST.job_states(e, "user_id", ["t", "event_id"], "generation", "action")


@query(f"""
WITH {_E}, v AS (SELECT user_id, list(t ORDER BY t) AS free FROM e WHERE event_type = 'view' GROUP BY user_id),
c AS (SELECT user_id, list(struct_pack(t := t, id := event_id, last := 0.0::DOUBLE, outs := []::STRUCT(id BIGINT, o DOUBLE, m BOOLEAN)[]) ORDER BY t, event_id) AS xs FROM e WHERE event_type = 'click' GROUP BY user_id),
j AS (SELECT c.user_id, xs, coalesce(free, []::DOUBLE[]) AS free FROM c LEFT JOIN v USING (user_id)),
r AS (SELECT user_id, list_reduce(list_prepend(struct_pack(t := 0.0::DOUBLE, id := 0::BIGINT, last := 0.0::DOUBLE, outs := []::STRUCT(id BIGINT, o DOUBLE, m BOOLEAN)[]), xs), lambda a, x: struct_pack(t := x.t, id := x.id,
  last := CASE WHEN len(list_filter(free, lambda y: y > a.last AND y >= x.t - 3600 AND y <= x.t + 3600)) > 0 THEN list_sort(list_transform(list_filter(free, lambda y: y > a.last AND y >= x.t - 3600 AND y <= x.t + 3600), lambda y: struct_pack(d := abs(y - x.t), y := y)))[1].y ELSE a.last END,
  outs := list_append(a.outs, CASE WHEN len(list_filter(free, lambda y: y > a.last AND y >= x.t - 3600 AND y <= x.t + 3600)) > 0 THEN struct_pack(id := x.id, o := list_sort(list_transform(list_filter(free, lambda y: y > a.last AND y >= x.t - 3600 AND y <= x.t + 3600), lambda y: struct_pack(d := abs(y - x.t), y := y)))[1].y, m := true) ELSE struct_pack(id := x.id, o := x.t, m := false) END))).outs AS outs FROM j)
SELECT user_id, u.id AS id, u.o AS onset, u.m AS matched FROM (SELECT user_id, unnest(outs) AS u FROM r)
""")
def strict_onset_match(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    notes = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), F.col("t").alias("ref"), F.lit(7200.0).alias("dur"))
    return M.monotone_onsets(notes, e.where("event_type = 'view'").select("user_id", "t"), ["user_id"], reach=3600.0, share=0.5)


@query(f"""
WITH {_E}, v AS (SELECT user_id, list(t ORDER BY t) AS free FROM e WHERE event_type = 'view' GROUP BY user_id),
c AS (SELECT user_id, list(struct_pack(t := t, free := []::DOUBLE[], outs := []::STRUCT(a DOUBLE, b DOUBLE)[]) ORDER BY t) AS xs FROM e WHERE event_type = 'click' GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_prepend(struct_pack(t := 0.0::DOUBLE, free := free, outs := []::STRUCT(a DOUBLE, b DOUBLE)[]), xs), lambda a, x: struct_pack(t := x.t,
  free := CASE WHEN len(list_filter(a.free, lambda y: abs(y - x.t) <= 3600)) > 0 THEN list_filter(a.free, lambda z: z <> list_sort(list_transform(list_filter(a.free, lambda y: abs(y - x.t) <= 3600), lambda y: struct_pack(d := abs(y - x.t), y := y)))[1].y) ELSE a.free END,
  outs := CASE WHEN len(list_filter(a.free, lambda y: abs(y - x.t) <= 3600)) > 0 THEN list_append(a.outs, struct_pack(a := x.t, b := list_sort(list_transform(list_filter(a.free, lambda y: abs(y - x.t) <= 3600), lambda y: struct_pack(d := abs(y - x.t), y := y)))[1].y)) ELSE a.outs END)).outs AS outs FROM c JOIN v USING (user_id))
SELECT user_id, u.a AS left_t, u.b AS right_t FROM (SELECT user_id, unnest(outs) AS u FROM r)
""")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return M.greedy_pairs(e.where("event_type = 'click'").select("user_id", "t"), e.where("event_type = 'view'").select("user_id", "t"), ["user_id"], 3600.0)


@query()
def outlier_anchors(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).groupBy("user_id", "day").agg(F.round(F.avg("value"), 6).alias("level")).withColumn("x", F.col("day").cast("double"))
    return L.reject_outliers(e, ["user_id"], "x", "level", least=5.0)


@query()
def take_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a written line, half a second a beat, against a take of it with notes left out, changed and added."""
    from tidemark.operators import performance as R

    k, i = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")), F.col("event_id")
    e = events(spark, d).select("user_id", "event_id", k.alias("k"), (48 + i % 24).cast("int").alias("midi"))
    notes = e.select("user_id", i.alias("id"), "midi", F.col("k").cast("double").alias("beat"))
    at = 1.0 + 0.5 * F.col("k") + i % 5 * 0.01
    played = e.where(i % 9 > 0).select("user_id", i.alias("id"), (F.col("midi") + F.when(i % 10 == 1, 1).otherwise(0)).alias("midi"), at.alias("t"))
    extra = e.where(i % 17 == 0).select("user_id", (-i - 1).alias("id"), (F.col("midi") + 30).alias("midi"), (at + 0.23).alias("t"))
    return R.align(notes, played.unionAll(extra), ["user_id"]).withColumn("expected", F.round("expected", 6))


@query("""
WITH n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, 1 + CAST(l_quantity AS BIGINT) % 4 AS d, [60, 62, 64, 65, 67, 69, 71][l_partkey % 7 + 1] AS midi, l_linenumber % 2 = 1 AS first,
             CASE WHEN l_linenumber % 2 = 1 AND round(l_discount * 100) >= 9 THEN 2 ELSE 0 END AS gap FROM lineitem),
v AS (SELECT *, count(*) FILTER (WHERE first) OVER w >= count(*) FILTER (WHERE NOT first) OVER w AS upper FROM n WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, CAST(sum(d + gap) OVER (PARTITION BY l_orderkey ORDER BY k) - d AS INTEGER) AS at, CAST(d AS INTEGER) AS duration, CAST(midi AS INTEGER) AS midi FROM v WHERE first = upper
""")
def projected_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a score of two voices (odd and even lines, gaps, chord tones), projected to its one line and read back with its places."""
    from tidemark.sources import edit, scan

    l = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    first = F.col("l_linenumber") % 2 == 1
    step = F.substring(F.lit("CDEFGAB"), (F.col("l_partkey") % 7 + 1).cast("int"), F.lit(1))
    length = 1 + F.col("l_quantity").cast("long") % 4
    gap = F.when(first & (F.round(F.col("l_discount") * 100) >= 9), 2).otherwise(0)
    note = lambda chord, name, octave: F.concat(F.lit(f"<note>{chord}<pitch><step>"), name, F.lit(f"</step><octave>{octave}</octave></pitch><duration>"), length.cast("string"), F.lit("</duration><voice>"), F.when(first, "1").otherwise("2"), F.lit("</voice></note>"))
    text = F.concat(F.when(gap > 0, "<forward><duration>2</duration></forward>").otherwise(""), note("", step, 4), F.when(F.round(F.col("l_tax") * 100) >= 7, note("<chord/>", F.lit("C"), 6)).otherwise(""))
    lines = l.select("l_orderkey", first.alias("first"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", text.alias("text")).alias("line"), F.when(first, length + gap).alias("long"))
    voice = lambda own: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(own, F.col("line")))), lambda x: x["text"]), "")
    back = F.when(F.sum("long") > 0, F.concat(F.lit("<backup><duration>"), F.sum("long").cast("string"), F.lit("</duration></backup>"))).otherwise("")
    body = lines.groupBy("l_orderkey").agg(voice(F.col("first")).alias("upper"), back.alias("back"), voice(~F.col("first")).alias("lower"))
    head, tail = '<score-partwise><part id="P"><measure><attributes><divisions>1</divisions></attributes>', "</measure></part></score-partwise>"
    scores = body.select("l_orderkey", F.concat(F.lit(head), "upper", "back", "lower", F.lit(tail)).alias("xml"))
    found = scan.tokens(edit.edited(scores, "xml", edit.monophonic, "line"), "l_orderkey", "line", placed=True)
    return found.where("NOT rest").select("l_orderkey", "at", "duration", "midi")


#: Of each user a root, a second tone some way above it, both out of tune by some cents; every fourth user leaves the second out.
_CHORDS = _E + """, c AS (SELECT user_id, 45 + user_id % 9 AS root, 45 + user_id % 9 + [3, 4, 5, 7, 12][user_id % 5 + 1] AS above, count(*) % 21 - 10 AS flat, min(event_id) % 21 - 10 AS sharp, count(*) % 4 > 0 AS played FROM e WHERE user_id IS NOT NULL GROUP BY user_id)"""


def _sounded(rate: int):
    """Half a second of silence, 0.8 s of both tones of six partials, 0.2 s of silence."""

    def run(batches):
        import numpy as np
        import pandas as pd

        i = np.arange(int(0.8 * rate))
        # A few takes at a time: a batch of rows may be thousands.
        for b in (b.iloc[k : k + 16] for b in batches for k in range(0, len(b), 16)):
            made = []
            for r in b.itertuples(index=False):
                x = np.zeros(int(1.5 * rate))
                for midi, cents, loud in ((r.root, r.flat, 0.2), (r.above, r.sharp, 0.2 * r.played)):
                    z, sound = np.exp(2j * np.pi * 440 * 2 ** ((midi + cents / 100 - 69) / 12) / rate * i), 0j
                    # Each partial is a power of the first, by its strength and phase.
                    for k in range(6, 0, -1):
                        sound = (sound + loud / k * np.exp(1j * k)) * z
                    x[int(0.5 * rate) : int(0.5 * rate) + len(i)] += sound.imag
                made.append(x)
            yield pd.DataFrame({"user_id": b["user_id"], "samples": made, "rate": rate})

    return run


def _sounded_batches(rate: int):
    """``_sounded`` as Arrow batches: pandas' way there costs more than the sounding."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for made in _sounded(rate)(b.to_pandas() for b in batches):
            samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made["samples"])]), pa.int32()), pa.array(np.concatenate(made["samples"].tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(made["user_id"], pa.int64()), samples, pa.array(made["rate"], pa.int32())], ["user_id", "samples", "rate"])

    return run


@query(f"""
WITH {_CHORDS} SELECT user_id, root::INTEGER AS midi, 'measured' AS state, true AS near FROM c UNION ALL
SELECT user_id, above::INTEGER, CASE WHEN NOT played THEN 'missing' WHEN above - root = 12 THEN 'inseparable' ELSE 'measured' END, CASE WHEN played AND above - root <> 12 THEN true END FROM c
""")
def chord_tone_states(spark: SparkSession, d: str) -> DataFrame:
    """Chords that Spark sounds from each user's events, measured tone by tone: ``near`` within three cents of what was sounded."""
    from tidemark.operators import partials as PA

    rate = 11_025
    root = 45 + F.col("user_id") % 9
    c = events(spark, d).where("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    above = root + F.get(F.array(*map(F.lit, (3, 4, 5, 7, 12))), (F.col("user_id") % 5).cast("int"))
    c = c.select("user_id", root.cast("int").alias("root"), above.cast("int").alias("above"), (F.col("n") % 21 - 10).alias("flat"), (F.col("first") % 21 - 10).alias("sharp"), (F.col("n") % 4 > 0).alias("played"))
    takes = dealt(c, ["user_id"]).mapInArrow(_sounded_batches(rate), "user_id long, samples array<double>, rate int")
    chords = c.select("user_id", F.lit(1).alias("id"), F.array("root", "above").alias("tones"), F.lit(0.5).alias("onset"), F.lit(1.3).alias("stop"))
    sounding = c.select("user_id", F.explode(F.when(F.col("played"), F.array("root", "above")).otherwise(F.array("root"))).alias("midi"), F.lit(0.5).alias("start"), F.lit(1.3).alias("stop"))
    found = PA.chord_tones(takes, chords, sounding, "user_id").join(c.select("user_id", "root", "flat", "sharp"), "user_id")
    return found.select("user_id", "midi", "state", (F.abs(F.col("cents") - F.when(F.col("midi") == F.col("root"), F.col("flat")).otherwise(F.col("sharp"))) <= 3).alias("near"))
