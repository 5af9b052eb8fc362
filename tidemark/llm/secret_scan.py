"""Secret scans: patterns, and sliding-window entropy of candidate strings.

DataFrame functions only; every document is judged in its own row, without a
shuffle. Candidates are long runs of one character class. A window slides over
each; character counts and the sum that entropy needs are updated by the
character that comes and the one that goes. A candidate whose best window
exceeds its class's threshold is a span, unless the allow-list knows it, it
stands in a URL ahead of its query, or it is made of words: paths, titles in
addresses and compound names have as much entropy as keys, but their segments
between separators are words, which those of random strings rarely are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, running

#: Patterns of the base kinds, in order; a match counts if its group has that many characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
#: What a text must hold for a kind to have any counted match; runs are the same when asked for their length at once.
LIKELY = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Same matches as the pattern of the kind, for runs of one class that are long enough.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

#: Characters of the sliding window.
WINDOW = 20


@dataclass(frozen=True)
class CharClass:
    """Candidates of these characters alone, that hold one of each kind needed."""

    name: str
    alphabet: str
    only: str  # pattern of a whole candidate
    needs: tuple[str, ...]
    bits: float  # entropy of a window from which on it counts


_DIGITS, _SMALL, _CAPITALS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A candidate is judged as the first class that its characters fit.
CLASSES = [
    CharClass("hex", _DIGITS + "abcdefABCDEF", "^[0-9A-Fa-f]+$", ("[0-9]", "[A-Fa-f]"), 3.0),
    CharClass("small and digits", _DIGITS + _SMALL, "^[0-9a-z]+$", ("[0-9]", "[a-z]"), 3.5),
    CharClass("capitals and digits", _DIGITS + _CAPITALS, "^[0-9A-Z]+$", ("[0-9]", "[A-Z]"), 3.5),
    CharClass("base64", _CAPITALS + _SMALL + _DIGITS + "+/=_-", "^[A-Za-z0-9+/=_-]+$", ("[0-9]", "[a-z]", "[A-Z]"), 3.6),
]
RUN = r"[A-Za-z0-9+/=_-]{20,}"
#: A URL up to its query is taken whole, so that no run within it is a candidate.
CANDIDATE = r"(?:https?|ftps?|ssh|git|s3|gs|file)://[^\x00-\x20?#\x22\x27<>]*|" + RUN
#: What parts a candidate's segments, and segments that are words: humps of letters, capitals, either with a short number, or a number.
PARTS = r"[-/_=+]+"
WORD = r"^(?:[A-Za-z]?[a-z]*(?:[A-Z][a-z]+)*[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8})$"
#: Allow-list: candidates that are no secrets, though they look random.
ALLOWED = [
    r"(?i)example|placeholder|changeme|dummy|sample|redacted",
    r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$",
    r"(?i)0123456789|abcdefghij|1234567890",
    r"^e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$",
    r"^da39a3ee5e6b4b0d3255bfef95601890afd80709$",
]

_SPAN = "array<struct<start:bigint,place:int,end:bigint,kind:string>>"
_SPOT = "array<struct<start:bigint,place:int,end:bigint,kind:string,text:string>>"


def _matches(text: Column, pattern: str, group: int, least: int, place: int, kind: str) -> Column:
    """Spans of the leftmost matches whose group has ``least`` characters, with the group's text: code points, end exclusive."""
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps, sizes = F.transform(F.split(text, pattern, -1), lambda p: F.length(p)), F.transform(whole, lambda m: F.length(m))

    def placed(steps: Column) -> Column:
        ends = running(F.transform(steps, lambda x: (x["gap"] + x["size"]).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        spot = lambda x: F.struct((x["end"] - x["step"]["size"]).alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["step"]["judged"].alias("text"))
        return F.transform(F.filter(F.arrays_zip(steps.alias("step"), ends.alias("end")), lambda x: F.length(x["step"]["judged"]) >= least), spot)

    # What follows the last match is no step.
    return let(F.slice(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), part.alias("judged")), F.lit(1), F.size(part)), placed)


def _bare(spots: Column) -> Column:
    return F.transform(spots, lambda s: F.struct(s["start"], s["place"], s["end"], s["kind"])).cast(_SPAN)


def _spans(text: Column, likely: str, *how) -> Column:
    return F.when(text.rlike(likely), _bare(_matches(text, *how))).otherwise(F.array().cast(_SPAN))


def entropy(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any window of the string; of a shorter string, its own.

    Counts are kept by character; with sum = total of c * log2(c), a window of
    w characters has entropy log2(w) - sum / w. A step changes two counts, and
    the sum by the terms of these two alone, so the time is in proportion to
    the string's length.
    """
    # x * log2(x), 0 for 0
    term = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    size = F.length(candidate)
    wide = F.least(size, F.lit(window)).cast("double")
    # instr is 1-based, so place 0 stands for a character outside the alphabet
    codes = F.transform(F.split(candidate, ""), lambda c, i: F.struct(F.instr(F.lit(alphabet), c).alias("come"), i.alias("i")))
    # What goes is what came a window ago; -1 as long as nothing does.
    before = F.concat(F.array_repeat(F.lit(-1), window), F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c)))
    steps = F.slice(F.arrays_zip(codes.alias("c"), before.alias("gone")), F.lit(1), size)
    # Counts are kept as characters, "A" for 0: Spark changes one in a string faster than in an array.
    begin = F.struct(F.lit("A" * (len(alphabet) + 1)).alias("n"), F.lit(0.0).cast("double").alias("sum"), F.lit(1e18).cast("double").alias("least"))
    count = lambda n, k: F.ascii(F.substring(n, k + 1, F.lit(1))) - 65
    put = lambda n, k, c: F.overlay(n, F.char(c + 65), k + 1, F.lit(1))

    def step(s: Column, x: Column) -> Column:
        come, gone = x["c"]["come"], x["gone"]
        same = come == gone
        c, g = count(s["n"], come), count(s["n"], gone)
        more = put(s["n"], come, c + 1)
        n = F.when(same, s["n"]).when(gone >= 0, put(more, gone, g - 1)).otherwise(more)
        total = s["sum"] + F.when(same, F.lit(0.0)).otherwise(term(c + 1) - term(c) + F.when(gone >= 0, term(g - 1) - term(g)).otherwise(F.lit(0.0)))
        at = x["c"]["i"] + 1
        low = F.when((at >= window) | (at == size), F.least(s["least"], total)).otherwise(s["least"])
        return F.struct(n.alias("n"), total.cast("double").alias("sum"), low.cast("double").alias("least"))

    done = F.aggregate(steps, begin, step)
    return F.when(size > 0, F.log2(wide) - done["least"] / wide).otherwise(F.lit(0.0))


def wordy(candidate: Column) -> Column:
    """Whether words make up at least half of the candidate's letters and digits."""
    segments = F.filter(F.split(candidate, PARTS), lambda x: x.rlike(WORD))
    return 2 * F.aggregate(segments, F.lit(0), lambda n, x: n + F.length(x)) >= F.length(F.regexp_replace(candidate, PARTS, ""))


def _random(candidate: Column) -> Column:
    """Whether the candidate's entropy is that of a secret of its class, and nothing allows it."""
    allowed = wordy(candidate)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    judged = F.lit(False)
    for c in reversed(CLASSES):
        fits = candidate.rlike(c.only)
        for need in c.needs:
            fits = fits & candidate.rlike(need)
        judged = F.when(fits, F.when(allowed, F.lit(False)).otherwise(entropy(candidate, c.alphabet) >= c.bits)).otherwise(judged)
    return judged


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every document: doc_id, base (spans of the base kinds), added (spans by entropy).

    A span has start, place (of its kind in order), end and kind; spans are
    sorted by start, then kind. A candidate for entropy is a run of 20 letters,
    digits and ``+/=_-`` at least, of one of the classes: hex digits; small
    letters with digits; capitals with digits; or all three. One of other
    characters (letters alone, say) is none, nor is one that words make up by half
    (``wordy``), or that stands in a URL ahead of its query. A span by entropy that lies within
    a base span isn't added. A null text is an empty one. Repeated rows each
    get their row; other columns are ignored; an empty table gives an empty
    result. Time grows with a text's length, whatever its runs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    for place, (kind, pattern, group, least) in enumerate(KINDS):
        found = found.withColumn(kind, _spans(F.col("text"), LIKELY[kind], LONG.get(kind, pattern), group, least, place, kind))
    found = found.withColumn("base", F.array_sort(F.concat(*(F.col(k[0]) for k in KINDS))))
    spots = F.when(F.col("text").rlike(CANDIDATE), _matches(F.col("text"), CANDIDATE, 0, WINDOW, len(KINDS), "entropy")).otherwise(F.array().cast(_SPOT))
    found = found.withColumn("spots", F.filter(spots, lambda s: ~s["text"].contains("://")))
    found = found.withColumn("free", F.when(F.size("spots") > 0, _uncovered(F.col("base"), F.col("spots"))).otherwise(F.array().cast(_SPOT)))
    return found.select("doc_id", "base", F.when(F.size("free") > 0, _bare(F.filter("free", lambda s: _random(s["text"])))).otherwise(F.array().cast(_SPAN)).alias("added"))


def _uncovered(base: Column, spots: Column) -> Column:
    """Spots that no base span holds: both in order, with the furthest end of a base span up to each."""
    known = F.transform(base, lambda b: F.struct(b["start"], b["place"], b["end"], b["kind"], F.lit(None).cast("string").alias("text"))).cast(_SPOT)

    def free(every: Column) -> Column:
        tops = running(F.transform(every, lambda x: F.when(x["text"].isNull(), x["end"]).otherwise(F.lit(-1).cast("long"))), F.lit(-1).cast("long"), lambda a, b: F.greatest(a, b))
        return F.transform(F.filter(F.arrays_zip(every.alias("spot"), tops.alias("top")), lambda x: x["spot"]["text"].isNotNull() & (x["top"] < x["spot"]["end"])), lambda x: x["spot"])

    return let(F.array_sort(F.concat(known, spots)), free)


def written(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
