"""Stateful behaviour: Structured Streaming jobs and their batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ready

#: Legal transitions of a job.
TRANSITIONS = {
    "idle": ["validating"], "validating": ["preparing", "failed", "cancelled"], "preparing": ["submitting", "failed", "cancelled"], "submitting": ["polling", "failed", "cancelled", "timed_out"],
    "polling": ["polling", "succeeded", "failed", "cancelled", "timed_out"], "succeeded": ["validating"], "failed": ["validating"], "cancelled": ["validating"], "timed_out": ["validating"],
}


def daily_usage(df: DataFrame, subject: str, ts: str, kind: str, limit: int) -> DataFrame:
    """Uses of a kind by a subject on a UTC day, and whether they exceed the limit. Works on streams with a watermark too."""
    out = df.groupBy(subject, F.date_format(ts, "yyyy-MM-dd").alias("day"), F.col(kind).alias("kind")).agg(F.count("*").alias("used"))
    return out.withColumn("over", F.col("used") > limit)


def usage_stream(stream: DataFrame, subject: str, ts: str, kind: str, retention: str = "40 days") -> DataFrame:
    """The same, incrementally: tumbling day windows, dropped after the retention."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", retention)
    return timed.groupBy(subject, F.window("_ts", "1 day").alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("used")).select(subject, F.date_format("w.start", "yyyy-MM-dd").alias("day"), "kind", "used")


def rate_limited(df: DataFrame, keys: list[str], ts: str, seconds: int, limit: int) -> DataFrame:
    """Adds ``recent`` (uses in the time up to each one, it included) and ``limited``."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    near = Window.partitionBy(*keys).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count("*").over(near)).withColumn("limited", F.col("recent") > limit)


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Gap sessions of a stream: start, end and size."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(*keys, F.session_window("_ts", gap).alias("s")).agg(F.count("*").alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def fold_states(actions: list[tuple[int, str]], start: str = "idle", generation: int = 0) -> tuple[str, int, int]:
    """(state, generation, rejected) after actions (generation, next state) in order.

    An action of an older generation is stale; one that isn't a legal next
    state is rejected; "validating" opens a generation.
    """
    state, rejected = start, 0
    for g, nxt in actions:
        if g < generation or nxt not in TRANSITIONS.get(state, []):
            rejected += 1
            continue
        state, generation = nxt, max(g, generation)
    return state, generation, rejected


def job_states(df: DataFrame, key: str, order: list[str], generation: str, action: str) -> DataFrame:
    """Batch twin: the final state of each job."""

    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        state, last, rejected = fold_states(list(zip(pdf[generation].tolist(), pdf[action].tolist(), strict=True)))
        return pd.DataFrame([(pdf[key].iloc[0], state, last, rejected)], columns=[key, "state", "generation", "rejected"])

    ready(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandas(fold, f"{key} {kind}, state string, generation long, rejected long")


def job_state_stream(stream: DataFrame, key: str, generation: str, action: str, seq: str) -> DataFrame:
    """Streaming form: state is kept by job; each batch emits the jobs it changed."""
    ready(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()

    def step(k, pdfs, state):
        import pandas as pd

        now, last, rejected = state.get if state.exists else ("idle", 0, 0)
        for pdf in pdfs:
            pdf = pdf.sort_values(seq)
            now, last, more = fold_states(list(zip(pdf[generation].tolist(), pdf[action].tolist(), strict=True)), now, last)
            rejected += more
        state.update((now, last, rejected))
        yield pd.DataFrame([(k[0], now, last, rejected)], columns=[key, "state", "generation", "rejected"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, generation long, rejected long", "state string, generation long, rejected long", "update", "NoTimeout")


def admitted(stream: DataFrame, content: str, ts: str, within: str = "1 hour") -> DataFrame:
    """Requests of a stream, each content once within the time."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", within).dropDuplicatesWithinWatermark([content]).drop("_ts")


def schedule(df: DataFrame, start: str, seconds_per_beat: str, beats: str) -> DataFrame:
    """Every beat of a row with its time."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.col(beats) - 1)).alias("beat")).withColumn("at", F.col(start) + F.col("beat") * F.col(seconds_per_beat))


def chunks(df: DataFrame, length: str, most: float) -> DataFrame:
    """Equal chunks of at most so long that cover a length: (k, from, to)."""
    n = F.greatest(F.lit(1), F.ceil(F.col(length) / most)).cast("int")
    parts = df.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("k"))
    return parts.withColumns({"from": F.col(length) * F.col("k") / F.col("_n"), "to": F.col(length) * (F.col("k") + 1) / F.col("_n")}).drop("_n")


def rolling_sessions(uses: DataFrame, key: str, t: str, id_col: str, ttl: float, refresh: float) -> DataFrame:
    """Uses of sessions in order, each with ``valid`` and ``expires``: a session lasts ``ttl`` seconds from its
    first use and is renewed by a use, once ``refresh`` seconds of that have passed. After it has expired
    every use is refused. A session's uses are one group."""
    ready(uses.sparkSession)

    def fold(pdf):
        import pandas as pd

        out, expires = [], None
        for r in pdf.sort_values([t, id_col]).itertuples(index=False):
            now = getattr(r, t)
            if expires is None:
                expires = now + ttl
            valid = expires >= now
            if valid and expires - now < ttl - refresh:
                expires = now + ttl
            out.append((getattr(r, id_col), valid, expires))
        return pd.DataFrame(out, columns=[id_col, "valid", "expires"])

    kind = uses.schema[id_col].dataType.simpleString()
    return uses.select(key, t, id_col).groupBy(key).applyInPandas(fold, f"{id_col} {kind}, valid boolean, expires double")


def codes_checked(tries: DataFrame, keys: list[str], order: list[str], right: Column, age: Column, ttl: float = 600.0, attempts: int = 5) -> DataFrame:
    """Adds ``accepted`` to tries of login codes: the first right one in time, if fewer than ``attempts``
    wrong ones came before it; after it the code is used up."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    wrong = F.coalesce(F.sum(F.when(right | (age > ttl), 0).otherwise(1)).over(w), F.lit(0))
    good = right & (age <= ttl) & (wrong < attempts)
    marked = tries.withColumn("_good", good)
    return marked.withColumn("accepted", F.col("_good") & ~F.coalesce(F.max("_good").over(w), F.lit(False))).drop("_good")
