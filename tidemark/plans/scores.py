"""Registered queries of the scalar rules: pitch, timing, labels, keys, requests, small languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import windows as W
from tidemark.plans.catalog import _E, query
from tidemark.sources.tables import events, load


@query("SELECT event_id, round(CASE WHEN value > 0 THEN 69 + 12 * log2(value / 440.0) END, 6) AS midi, round(440.0 * pow(2.0, (value - 69.0) / 12.0), 4) AS hz FROM events")
def pitch_frequencies(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "value")
    return e.select("event_id", F.round(X.hz_to_midi(F.col("value")), 6).alias("midi"), F.round(X.midi_to_hz(F.col("value")), 4).alias("hz"))


_TIMING = "CASE WHEN {0} IS NULL THEN 'uncertain' WHEN {0} > {1} THEN 'late' WHEN {0} < -{1} THEN 'early' ELSE 'correct' END"


@query(f"""
WITH e AS (SELECT event_id, value, round((value - 50.0) * 100.0, 1) AS cents, value - 100 AS err, least(120.0, greatest(50.0, 150.0 * (value / 200.0))) AS lim FROM events)
SELECT event_id, cents, {_TIMING.format('err', '80.0')} AS timing, {_TIMING.format('err', 'lim')} AS by_tempo, lim AS "limit" FROM e
""")
def timing_status(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "value").withColumns({"err": F.col("value") - 100, "limit": X.timing_limit(F.col("value") / 200.0)})
    return e.select("event_id", X.cents(F.col("value"), F.lit(50.0)).alias("cents"), X.classify_timing(F.col("err")).alias("timing"), X.classify_timing(F.col("err"), F.col("limit")).alias("by_tempo"), "limit")


@query(f"""
WITH e AS (SELECT event_id, (value - 100) * 20 AS dev, value - 100 AS err FROM events),
s AS (SELECT event_id, CASE WHEN dev IS NULL THEN 'uncertain' WHEN abs(abs(dev) - 1200) <= 80 THEN 'octave' WHEN abs(dev) > 1200 THEN 'outlier' WHEN abs(dev) <= 25 THEN 'correct' WHEN dev > 0 THEN 'sharp' ELSE 'flat' END AS p, {_TIMING.format('err', '80.0')} AS t FROM e)
SELECT event_id, CASE WHEN p IN ('sharp', 'flat') THEN 'wrong_pitch' WHEN p = 'octave' THEN 'octave_uncertain' WHEN p IN ('outlier', 'uncertain') THEN p WHEN t IN ('late', 'early') THEN t WHEN t = 'uncertain' THEN 'timing_uncertain' ELSE 'correct' END AS status FROM s
""")
def merged_status(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events", "event_id", "value")
    return e.select("event_id", X.merge_status(X.classify_deviation((F.col("value") - 100) * 20), X.classify_timing(F.col("value") - 100)).alias("status"))


@query("""
WITH o AS (SELECT o_orderkey, (o_custkey % 120)::DOUBLE AS s, (o_orderkey % 400 - 200)::DOUBLE AS f FROM orders)
SELECT o_orderkey, round_even(greatest(0.0, 100.0 - (greatest(0.0, s - 15.0) * 0.5 + greatest(0.0, abs(f) - 30.0) * 0.15)), 0) AS score, round_even(greatest(0.0, 100.0 - s * 0.5 - abs(f) * 0.15), 0) AS strict FROM o
""")
def rhythm_scores(spark: SparkSession, d: str) -> DataFrame:
    s, f = (F.col("o_custkey") % 120).cast("double"), (F.col("o_orderkey") % 400 - 200).cast("double")
    return load(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", X.rhythm_score(s, f).alias("score"), X.strict_rhythm_score(s, f).alias("strict"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber * 3 AS beats, CASE WHEN l_quantity % 2 = 0 THEN 8 ELSE 4 END AS unit, l_quantity - 3 AS bpm FROM lineitem),
p AS (SELECT *, CASE WHEN unit = 8 AND beats IN (6, 9, 12) THEN 1.5 ELSE 4.0 / unit END AS pulse FROM l)
SELECT l_orderkey, l_linenumber, pulse::DOUBLE AS pulse, round(CASE WHEN bpm > 0 THEN 60.0 / bpm / pulse END, 9)::DOUBLE AS spq FROM p
""")
def meter_pulse(spark: SparkSession, d: str) -> DataFrame:
    beats, unit = F.col("l_linenumber") * 3, F.when(F.col("l_quantity") % 2 == 0, 8).otherwise(4)
    l = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return l.select("l_orderkey", "l_linenumber", X.pulse_quarters(beats, unit).cast("double").alias("pulse"), F.round(X.seconds_per_quarter(F.col("l_quantity") - 3, beats, unit), 9).alias("spq"))


@query("SELECT event_id, (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[1 + event_id % 128 % 12] || ((event_id % 128) // 12 - 1)::VARCHAR AS name FROM events")
def note_names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events", "event_id").select("event_id", X.note_name(F.col("event_id") % 128).alias("name"))


@query("""
WITH p AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 101) / 100.0 END AS p, event_type = 'error' AS hidden FROM events),
m AS (SELECT event_id, p, CASE WHEN hidden THEN 0.5 + (p - 0.5) * 0.5 ELSE p END AS q FROM p)
SELECT event_id, round(q, 9)::DOUBLE AS p, CASE WHEN q IS NULL THEN 'unchecked' WHEN q >= 0.7 THEN 'heard' WHEN q <= 0.3 THEN 'absent' ELSE 'unclear' END AS verdict FROM m
""")
def note_verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("event_id") % 9 != 0, (F.col("event_id") % 101) / 100.0)
    q = F.round(X.masked(p, F.col("event_type") == "error"), 9)
    return load(spark, d, "events", "event_id", "event_type").select("event_id", q.alias("p"), X.verdict(q).alias("verdict"))


@query("""
WITH n AS (SELECT event_id, CASE WHEN value < 5 THEN NULL ELSE (value - 60) * 25 END AS dev, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 30 + event_id % 70 END AS midi,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'correct' WHEN 2 THEN 'sharp' ELSE 'octave' END AS ps, CASE WHEN event_type = 'error' THEN 'excluded' ELSE 'correct' END AS st FROM events)
SELECT event_id, dev IS NOT NULL AND abs(dev) <= 1200 AND abs(abs(dev) - 1200) > 80 AND (midi IS NULL OR midi + dev / 100.0 BETWEEN 36 AND 96)
  AND CASE WHEN ps IS NOT NULL THEN ps IN ('correct', 'sharp', 'flat') ELSE st NOT IN ('uncertain', 'octave_uncertain', 'outlier', 'missed', 'excluded') END AS scored FROM n
""")
def scored_pitches(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    own = F.when(i % 4 == 1, "correct").when(i % 4 == 2, "sharp").when(i % 4 == 3, "octave")
    status = F.when(F.col("event_type") == "error", "excluded").otherwise("correct")
    e = load(spark, d, "events", "event_id", "value", "event_type")
    return e.select("event_id", X.scored_pitch(F.when(F.col("value") >= 5, (F.col("value") - 60) * 25), F.when(i % 5 != 0, 30 + i % 70), own, status).alias("scored"))


@query(f"""
WITH {_E}, n AS (SELECT event_id, user_id, day, t, (['C', 'D', 'E', 'F', 'G', 'A', 'B'])[1 + event_id % 7] AS step, ([0, 2, 4, 5, 7, 9, 11])[1 + event_id % 7] AS base, 4 + event_id % 2 AS octave,
  CASE WHEN event_id % 5 = 0 THEN event_id % 3 - 1 END AS printed FROM e),
h AS (SELECT *, coalesce(last_value(printed IGNORE NULLS) OVER (PARTITION BY user_id, day, step, octave ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), CASE WHEN step = 'F' THEN 1 END, 0) AS alter FROM n)
SELECT event_id, alter::BIGINT AS alter, ((octave + 1) * 12 + base + alter)::BIGINT AS midi FROM h
""")
def resolved_pitches(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    step = F.element_at(F.array(*(F.lit(x) for x in "CDEFGAB")), (i % 7 + 1).cast("int"))
    e = events(spark, d).withColumn("octave", 4 + i % 2)
    held = W.resolved_pitch(e, ["user_id", "day"], ["t", "event_id"], step, "octave", F.when(i % 5 == 0, i % 3 - 1), F.when(step == "F", 1).cast("long"))
    return held.select("event_id", F.col("alter").cast("long").alias("alter"), F.col("midi").cast("long").alias("midi"))


@query("""
WITH n AS (SELECT doc_id, source || '  ' || upper(lang) || repeat(' Part' || chr(9), (doc_id % 60)::BIGINT) || CASE doc_id % 3 WHEN 0 THEN '.XML' WHEN 1 THEN '.tar.mxl' ELSE '' END AS name FROM documents)
SELECT doc_id, substr(lower(trim(regexp_replace(regexp_replace(name, '\\.[A-Za-z0-9]+$', ''), '\\s+', ' ', 'g'))), 1, 200) AS key FROM n
""")
def score_keys(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    ending = F.when(i % 3 == 0, ".XML").when(i % 3 == 1, ".tar.mxl").otherwise("")
    name = F.concat("source", F.lit("  "), F.upper("lang"), F.repeat(F.lit(" Part\t"), (i % 60).cast("int")), ending)
    return load(spark, d, "documents", "doc_id", "source", "lang").select("doc_id", X.key_of_name(name).alias("key"))


@query("""
WITH c AS (SELECT c_custkey, c_mktsegment, lower(trim('  ' || replace(c_name, '#', '.') || '@Mail' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.Org ' END)) AS mail FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(mail, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AND length(mail) <= 254 THEN mail END AS email, strftime(make_timestamp((c_custkey * 86399 * 1000000)::BIGINT), '%Y-%m-%d') AS day,
  sha256('{"p0":' || c_custkey || ',"p1":"' || c_mktsegment || '"}') AS content, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(c_mktsegment, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (h * 33 + x) % 4294967296) AS djb2 FROM c
""")
def account_keys(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    raw = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Mail"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(".Org "))
    return c.select("c_custkey", X.email_of(raw).alias("email"), X.utc_day(F.col("c_custkey") * 86399).alias("day"), X.content_key(F.col("c_custkey"), F.col("c_mktsegment")).alias("content"), X.djb2(F.col("c_mktsegment")).alias("djb2"))


@query("""
SELECT event_id, concat_ws(',', CASE WHEN event_id % 2 = 0 THEN 'pitch:builtin' END, CASE WHEN event_id % 3 = 0 THEN 'onset:builtin' END, CASE WHEN event_type = 'error' THEN 'beat:rejected' WHEN event_id % 5 = 0 THEN 'beat:legacy' END) AS reasons FROM events
""")
def sensor_reasons(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    reasons = X.degradation(i % 2 != 0, i % 3 != 0, i % 5 != 0, F.col("event_type") == "error")
    return load(spark, d, "events", "event_id", "event_type").select("event_id", F.array_join(reasons, ",").alias("reasons"))


@query("SELECT event_id, event_id % 128 + 5 AS up, event_id % 128 - 12 AS octave_down FROM events")
def transposed(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 128
    return load(spark, d, "events", "event_id").select("event_id", X.transpose(m, 5).alias("up"), X.transpose(m, -10, octave_only=True).alias("octave_down"))


@query(f"""
WITH {_E}, i AS (SELECT event_id, floor((t - 1704100000.0) / 1800.0)::BIGINT AS i FROM e)
SELECT event_id, i AS "index", (floor(i / 4.0) + 1)::BIGINT AS measure, (i - 4 * floor(i / 4.0) + 1)::BIGINT AS beat FROM i
""")
def score_clock(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("event_id", X.beat_at(F.col("t"), F.lit(1704100000.0), F.lit(1800.0), F.lit(4)).alias("b"))
    return e.select("event_id", "b.index", "b.measure", "b.beat")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 10 END AS bpm, l_linenumber * 20 AS tol, l_linenumber - 2 AS start FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN bpm IS NULL OR bpm NOT BETWEEN 15 AND 360 THEN 'bpm' END, CASE WHEN tol NOT BETWEEN 1 AND 100 THEN 'tolerance' END, CASE WHEN start < 0 THEN 'start_measure' END) AS refused FROM r
""")
def request_checks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    l = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return l.select("l_orderkey", "l_linenumber", F.array_join(X.within_request(F.when(n != 7, F.col("l_quantity") * 10), n * 20, n - 2), ",").alias("refused"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN true ELSE 400 + event_id % 120 IN (408, 425, 429) OR 400 + event_id % 120 >= 500 END AS retry FROM events")
def retry_class(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") != "error", 400 + F.col("event_id") % 120)
    return load(spark, d, "events", "event_id", "event_type").select("event_id", X.retryable(status).alias("retry"))


@query("""
WITH h AS (SELECT event_id, ts, CASE WHEN value BETWEEN 0 AND 100 THEN value END AS pitch, CASE WHEN event_id % 150 <= 100 THEN event_id % 150 END AS rhythm FROM events)
SELECT event_id, pitch, rhythm::BIGINT AS rhythm FROM h WHERE pitch IS NOT NULL OR rhythm IS NOT NULL
""")
def history_points(spark: SparkSession, d: str) -> DataFrame:
    h = load(spark, d, "events", "event_id", "value").select("event_id", X.finite_score(F.col("value")).alias("pitch"), X.finite_score((F.col("event_id") % 150).cast("double")).cast("long").alias("rhythm"))
    return h.where("pitch IS NOT NULL OR rhythm IS NOT NULL")


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 9 + 1 AS a, o_orderkey % 20 + 1 AS b, o_custkey % 30 AS c FROM orders)
SELECT o_orderkey, concat_ws(';', CASE WHEN a <= b THEN a || '-' || b END, c || '-' || c) AS ranges, CASE WHEN a = c THEN 4 ELSE 3 END AS beats FROM o
""")
def mini_languages(spark: SparkSession, d: str) -> DataFrame:
    """Ranges and meters as they are typed: of a measure given twice the later entry would be an error, so it is left out."""
    o = load(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", (F.col("o_orderkey") % 9 + 1).alias("a"), (F.col("o_orderkey") % 20 + 1).alias("b"), (F.col("o_custkey") % 30).alias("c"))
    text = F.concat(F.col("a").cast("string"), F.lit(" - "), F.col("b").cast("string"), F.lit(", "), F.col("c").cast("string"), F.lit(",x, 3-"))
    meters = F.concat(F.col("a").cast("string"), F.lit(": 4, 1000:3, bad"))
    ranges = F.array_join(F.transform(X.parse_ranges(text), lambda r: F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string"))), ";")
    return o.select("o_orderkey", ranges.alias("ranges"), F.coalesce(F.element_at(X.parse_meters(meters), F.col("c").cast("int")), F.lit(3)).alias("beats"))


@query("""
WITH p AS (SELECT page_id, substr(md5(url), 1, 11) AS id FROM pages)
SELECT page_id, CASE WHEN page_id % 6 < 5 THEN id END AS video FROM p
""")
def video_ids(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "pages", "page_id", "url").withColumn("id", F.substring(F.md5("url"), 1, 11))
    forms = ["https://www.youtube.com/watch?t=3&v={}&list=x", "https://youtu.be/{}?t=1", "https://www.youtube.com/embed/{}", "https://youtube.com/shorts/{}#a", "https://www.youtube.com/live/{}", "https://example.org/{}"]
    url = F.element_at(F.array(*(F.concat(F.lit(f.split("{}")[0]), F.col("id"), F.lit(f.split("{}")[1])) for f in forms)), (F.col("page_id") % 6 + 1).cast("int"))
    return p.select("page_id", X.video_id(url).alias("video"))


@query("""
WITH x AS (SELECT p_partkey, [p_size % 12 + 1, p_partkey % 16 + 1, 4] AS d FROM part), k AS (SELECT p_partkey, d, lcm(d[1], d[2]) AS m FROM x)
SELECT p_partkey, lcm(m, d[3])::BIGINT AS divisions FROM k
""")
def common_divisions(spark: SparkSession, d: str) -> DataFrame:
    dens = [F.col("p_size") % 12 + 1, F.col("p_partkey") % 16 + 1, F.lit(4)]
    lengths = F.array(*(F.struct(F.lit(1).cast("long").alias("num"), x.cast("long").alias("den")) for x in dens))
    return load(spark, d, "part", "p_partkey", "p_size").select("p_partkey", X.common_divisions(lengths).alias("divisions"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're')")
def catalogue_search(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part", "p_partkey", "p_name").where(F.contains(F.lower("p_name"), F.lit("re")))


@query(f"""
WITH {_E}, s AS (SELECT user_id, t, event_id % 6 AS bar, lead(t) OVER w AS nxt, t - lag(t) OVER w AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
k AS (SELECT user_id, t, bar, first_value(CASE WHEN bar = 4 THEN struct_pack(t := t, nxt := nxt, gap := gap) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM s),
p AS (SELECT user_id, greatest(0.0, t - 0.15) AS start, coalesce(k.nxt, k.t + greatest(0.5, coalesce(k.gap, 2.0))) AS stop FROM k WHERE bar = 2 AND k IS NOT NULL)
SELECT user_id, round(start, 6) AS start, round(stop, 6) AS stop FROM p WHERE stop > start + 0.2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN 1705000000.0 >= start AND 1705000000.0 < stop THEN 0 WHEN start >= 1705000000.0 THEN 1 ELSE 2 END, start, stop) = 1
""")
def loop_window(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).select("user_id", "t", (F.col("event_id") % 6).alias("bar"))
    found = W.loop_windows(s, ["user_id"], "t", "bar", F.lit(2), F.lit(4), F.lit(1705000000.0))
    return found.select("user_id", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


@query(f"WITH {_E} SELECT user_id, min_by(event_id, t) AS first, max_by(event_id, t) AS last FROM e GROUP BY user_id")
def edge_notes(spark: SparkSession, d: str) -> DataFrame:
    return W.edges(events(spark, d), ["user_id"], "t", "event_id")


@query(f"""
WITH {_E}, p AS (SELECT user_id, list(struct_pack(b := value, s := t - 1704067200) ORDER BY t, event_id) AS ps FROM e WHERE value IS NOT NULL GROUP BY user_id),
k AS (SELECT user_id, list_reduce(list_transform(ps, lambda p: [p]), lambda a, x: CASE WHEN x[1].b > a[-1].b + 0.01 AND x[1].s > a[-1].s + 0.001 THEN list_concat(a, x) ELSE a END) AS kept FROM p)
SELECT user_id, round(u.b, 6) AS beat, round(u.s, 3) AS sec FROM (SELECT user_id, unnest(kept) AS u FROM k)
""")
def increasing_anchors(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("value IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))).alias("rows"))
    pairs = F.transform("rows", lambda r: F.struct(r["value"].alias("beat"), (r["t"] - 1704067200).alias("sec")))
    kept = e.select("user_id", F.explode(F.filter(W.increasing(pairs, 0.01), lambda p: p.isNotNull())).alias("p"))
    return kept.select("user_id", F.round("p.beat", 6).alias("beat"), F.round("p.sec", 3).alias("sec"))


@query(f"""
WITH {_E}, c AS (SELECT user_id, t, value AS v, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING) AS segment, event_type = 'view' AS onset FROM e)
SELECT user_id, segment::BIGINT AS segment, round(min(t), 6) AS start, round(max(t), 6) AS stop, round(median(CASE WHEN NOT onset THEN v END), 6) AS value, count(CASE WHEN NOT onset THEN v END) AS frames FROM c WHERE segment > 0
GROUP BY user_id, segment HAVING max(t) - min(t) >= 600 AND count(CASE WHEN NOT onset THEN v END) > 0
""")
def segment_frames(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    found = W.segment_frames(e.where("event_type <> 'view'"), e.where("event_type = 'view'").select("user_id", "t"), ["user_id"], "t", "value", 600.0)
    return found.select("user_id", F.col("segment").cast("long").alias("segment"), F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), F.round("value", 6).alias("value"), "frames")


@query(f"""
WITH {_E}, p AS (SELECT user_id, list([struct_pack(t := t, v := value)] ORDER BY value DESC, t) AS ps FROM e WHERE value IS NOT NULL GROUP BY user_id),
k AS (SELECT user_id, unnest(list_reduce(ps, lambda a, x: CASE WHEN len(list_filter(a, lambda y: abs(y.t - x[1].t) <= 36000)) = 0 THEN list_concat(a, x) ELSE a END)) AS u FROM p)
SELECT user_id, round(u.t, 6) AS t, u.v AS value FROM k
""")
def suppressed_peaks(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("value IS NOT NULL")
    return W.suppress(e, ["user_id"], "t", "value", 36000.0).select("user_id", F.round("t", 6).alias("t"), "value")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Events as (start, stop, pitch): each lasts 1 to 40 minutes."""
    return events(spark, d).select("user_id", F.col("t").alias("start"), (F.col("t") + 60.0 * (1 + F.col("event_id") % 40)).alias("stop"), (F.col("event_id") % 61 + 36).cast("double").alias("pitch"))


_SPANS = _E + ", s AS (SELECT user_id, t AS start, t + 60.0 * (1 + event_id % 40) AS stop, (event_id % 61 + 36)::DOUBLE AS pitch FROM e)"


@query(f"""
WITH {_SPANS}, l AS (SELECT user_id, list([struct_pack(head := start, start := start, stop := stop, pitch := pitch)] ORDER BY start, pitch) AS xs FROM s GROUP BY user_id),
g AS (SELECT user_id, list_reduce(xs, lambda a, x: CASE WHEN x[1].start - a[-1].head > 900.0 THEN list_concat(a, x) WHEN x[1].pitch < a[-1].pitch THEN list_concat(a[1 : len(a) - 1], [struct_pack(head := a[-1].head, start := a[-1].start, stop := x[1].stop, pitch := x[1].pitch)]) ELSE a END) AS ys FROM l),
u AS (SELECT user_id, unnest(ys) AS y FROM g)
SELECT user_id, round(y.start, 6) AS start, round(least(y.stop, coalesce(lead(y.start) OVER (PARTITION BY user_id ORDER BY y.start) - 0.001, y.stop)), 6) AS stop, y.pitch AS pitch FROM u
""")
def mono_events(spark: SparkSession, d: str) -> DataFrame:
    return W.mono(_spans(spark, d), ["user_id"], window=900.0).select("user_id", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), "pitch")


@query(f"""
WITH {_SPANS}, l AS (SELECT user_id, list([struct_pack(start := start, stop := stop, ps := [pitch])] ORDER BY start, stop, pitch) AS xs FROM s GROUP BY user_id),
g AS (SELECT user_id, list_reduce(xs, lambda a, x: CASE WHEN x[1].start - a[-1].start <= 300.0 OR (x[1].start - a[-1].start <= 1800.0 AND x[1].start < a[-1].stop - 120.0)
  THEN list_concat(a[1 : len(a) - 1], [struct_pack(start := a[-1].start, stop := greatest(a[-1].stop, x[1].stop), ps := list_concat(a[-1].ps, x[1].ps))]) ELSE list_concat(a, x) END) AS ys FROM l),
u AS (SELECT user_id, unnest(ys) AS y FROM g),
c AS (SELECT user_id, y.start AS start, least(y.stop, coalesce(lead(y.start) OVER (PARTITION BY user_id ORDER BY y.start) - 0.001, y.stop)) AS stop, array_to_string(list_sort(list_distinct(list_transform(y.ps, lambda p: p::INTEGER))), ' ') AS pitches FROM u)
SELECT user_id, round(start, 6) AS start, round(stop, 6) AS stop, pitches FROM c WHERE stop > start
""")
def rolled_chords(spark: SparkSession, d: str) -> DataFrame:
    c = W.rolled_chords(_spans(spark, d), ["user_id"], together=300.0, roll=1800.0, ring=120.0)
    pitches = F.array_join(F.transform("pitches", lambda p: p.cast("int")).cast("array<string>"), " ")
    return c.select("user_id", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), pitches.alias("pitches"))


@query(f"WITH {_E} SELECT user_id, phrase::BIGINT AS phrase, min(event_id) AS first, count(*) AS n FROM (SELECT user_id, event_id, floor((row_number() OVER (PARTITION BY user_id ORDER BY t) - 1) / 4) + 1 AS phrase FROM e) GROUP BY user_id, phrase")
def phrase_groups(spark: SparkSession, d: str) -> DataFrame:
    return W.phrases(events(spark, d), ["user_id"], "t", 4).groupBy("user_id", "phrase").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))


@query(f"""
WITH {_SPANS}, o AS (SELECT user_id, start, stop, pitch FROM s WHERE stop - start >= 120.0 AND pitch BETWEEN 40 AND 90)
SELECT user_id, round(start, 6) AS start, round(stop, 6) AS stop, pitch FROM o WINDOW w AS (PARTITION BY user_id ORDER BY start, pitch) QUALIFY lag(stop) OVER w IS NULL OR start >= lag(stop) OVER w - 0.001
""")
def usable_events(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators import alignment as L

    long = _spans(spark, d).where("stop - start >= 120.0 AND pitch BETWEEN 40 AND 90")
    return L.usable_events(long, ["user_id"]).select("user_id", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), "pitch")


@query("""
SELECT event_id, least(2.5, least(abs(event_id % 40 - value % 37), abs(abs(event_id % 40 - value % 37) - 12) + 0.75)) AS cost,
  len(list_filter([0.5, 2 / 3, 1.0, 1.5, 2.0], lambda r: abs(value / (60.0 * r) - 1.0) <= 0.12)) > 0 AS pulse FROM events WHERE value IS NOT NULL
""")
def edit_costs(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators import alignment as L

    e = load(spark, d, "events", "event_id", "value").where("value IS NOT NULL")
    return e.select("event_id", L.pitch_cost(F.col("event_id") % 40, F.col("value") % 37).alias("cost"), L.pulse_fits(F.col("value"), F.lit(60.0)).alias("pulse"))


@query(f"""
WITH {_E}, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) AS x, (t - 1704067200.0) / 3600 AS y FROM e WHERE event_id % 3 = 0), g AS (SELECT user_id, x, y, lag(y) OVER (PARTITION BY user_id ORDER BY x) AS py FROM p)
SELECT user_id, count(*) AS points, CASE WHEN count(*) >= 2 AND bool_and(py IS NULL OR y > py) THEN round(max(abs(5.0 + x * 20.0 - y)), 6) END AS deviation, CASE WHEN count(*) >= 2 AND bool_and(py IS NULL OR y > py) THEN max(abs(5.0 + x * 20.0 - y)) > 300 END AS disagrees FROM g GROUP BY user_id
""")
def grid_arbitration(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators import alignment as L

    p = events(spark, d).where("event_id % 3 = 0").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("t")).alias("x"), ((F.col("t") - 1704067200.0) / 3600).alias("y"))
    return L.grid_disagrees(p, ["user_id"], "x", "y", F.lit(5.0), F.lit(20.0), 300.0).select("user_id", "points", F.round("deviation", 6).alias("deviation"), "disagrees")


@query(f"""
WITH {_E}, s AS (SELECT user_id, lead(t) OVER (PARTITION BY user_id ORDER BY t) - t AS r FROM e), p AS (SELECT user_id, r FROM s WHERE r > 0), m AS (SELECT user_id, list_sort(list(r)) AS rs FROM p GROUP BY user_id),
k AS (SELECT user_id, len(rs) AS segments, list_filter(rs, lambda r: r <= 2 * rs[len(rs) // 2 + 1]) AS kept FROM m WHERE len(rs) >= 2)
SELECT user_id, segments, round((kept[(len(kept) - 1) // 2 + 1] + kept[len(kept) // 2 + 1]) / 2, 6) AS tempo FROM k
""")
def segment_tempo(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators import alignment as L

    a = events(spark, d).select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("t")).alias("x"), "t")
    return L.segment_tempo(a, ["user_id"], "x", "t").select("user_id", "segments", F.round("tempo", 6).alias("tempo"))
