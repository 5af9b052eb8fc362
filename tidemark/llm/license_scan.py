"""License scans: phrases, and an exact set-similarity join with notice templates.

DataFrame functions only, and no shuffle of documents. A text block is a run of
consecutive words, a little longer than the template that it is held against,
so a notice may be wrapped over lines, and prose that scatters its words over a
page isn't one. Words are ordered rare-first by how many documents hold them. A
block can only hold enough of a template if it holds a word of the template's
prefix in that order: documents are joined with templates on prefix words, and
blocks pass length and positional filters before they are verified on whole sets.

The template side is a constant, so its size is bounded; the join with it is
made within each document's row.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, lower_ascii

#: Phrases, and the label that each stands for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices, and the label that each stands for.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Share of a template's words that a block must hold.
CONTAINMENT = 0.9

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MATCH = "array<struct<start:int,end:int,share:double,label:string,template:int>>"


class Template(NamedTuple):
    label: str
    words: list[str]  # distinct
    need: int  # words that a block must hold
    span: int  # words of a block


def template_sets(templates: list[tuple[str, str]], containment: float = CONTAINMENT) -> list[Template]:
    """The templates as sets. A block has a fifth more words than the template's text, one at least."""
    fold = {i: i + 32 for i in range(65, 91)}
    texts = [(label, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(fold))) for label, text in templates]
    return [Template(label, sorted(set(w)), max(1, math.ceil(containment * len(set(w)) - 1e-9)), len(w) + max(1, len(w) // 5)) for label, w in texts if w]


def nested(sets: list[Template]) -> list[list[int]]:
    """Of each template the numbers of those that hold all of its words, and more."""
    return [[k for k, larger in enumerate(sets) if set(t.words) < set(larger.words)] for t in sets]


def _words(text: Column) -> Column:
    """A-Z lower-cased; words are other letters, digits and non-ASCII."""
    plain = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS, " "))
    return let(plain, lambda p: F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(p, " ")))


def _places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase starts."""
    parts = phrase.split(" ")

    def here(w: Column, i: Column) -> Column:
        meets = w == parts[0]
        for k, part in enumerate(parts[1:], 1):
            meets = meets & (F.get(words, i + k) == part)
        return F.when(meets, i)

    return F.when(F.array_contains(words, parts[-1]), F.array_compact(F.transform(words, here))).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Licence evidence of every document.

    Returns doc_id, n_words, n_base (all places of phrases), first_word and
    last_word (their smallest and largest start, words from 0; else null),
    base_labels, template_labels (arrays, distinct and sorted), score: 1 with a
    phrase, else the largest share of a template's words that a block holds, if
    that reaches ``containment``, else 0. A block starts with a word of the
    template. Where blocks of several templates overlap, those with the largest
    share give their labels; of equal shares a template whose words another one
    holds as well gives none (a GNU Affero notice has all words of the GNU
    General one), and all others do.

    A null text is an empty one, and has no words. Repeated rows each get
    their row, and equal rows equal results. Other columns are ignored. An
    empty table gives an empty result. Time grows with a text's length.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("words"))
    sets, order = _ordered(plain, template_sets(templates, containment))
    found = plain.withColumns({f"p{i}": _places(F.col("words"), phrase) for i, phrase in enumerate(phrases)}).withColumn("held", _held(F.col("words"), sets, order))
    every = F.concat(*(F.col(f"p{i}") for i in range(len(phrases))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))
    score = F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("held", lambda m: m["share"])), F.lit(0.0)))
    return found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.transform("held", lambda m: m["label"]))).alias("template_labels"), score.alias("score"),
    )


def _ordered(plain: DataFrame, sets: list[Template]) -> tuple[list[Template], list[str]]:
    """The templates with their words rare-first, and all of their words in that order.

    The driver gets one count for each word of the templates, from all documents.
    """
    vocabulary = sorted({w for t in sets for w in t.words})
    known = F.array(*(F.lit(w) for w in vocabulary))
    counts = plain.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in counts}
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    return [t._replace(words=sorted(t.words, key=place.__getitem__)) for t in sets], order


def _held(words: Column, sets: list[Template], order: list[str]) -> Column:
    """Blocks of a document that hold enough of a template, the strongest where they overlap."""
    texts = lambda x: F.array(*(F.lit(w) for w in x))
    prefix = [t.words[: len(t.words) - t.need + 1] for t in sets]
    side = F.array(*(F.struct(F.lit(t.label).alias("label"), texts(t.words).alias("words"), texts(p).alias("prefix"), F.lit(t.need).alias("need"), F.lit(t.span).alias("span"), F.lit(k).alias("template")) for k, (t, p) in enumerate(zip(sets, prefix, strict=True))))
    larger = F.array(*(F.array(*map(F.lit, x)).cast("array<int>") for x in nested(sets)))
    firsts = texts(sorted({w for p in prefix for w in p}))
    vocabulary = texts(order)

    def blocks(t: Column) -> Column:
        def starts(spots: Column) -> Column:
            # Length: a block needs that many of the template's words, repeats and all.
            return F.array_compact(F.transform(spots, lambda p, k: F.when(F.get(spots, k + t["need"] - 1) - p < t["span"], p)))

        def judged(p: Column) -> Column:
            return let(F.array_intersect(vocabulary, F.slice(words, p + 1, t["span"])), lambda block: F.when(_close(t, block), F.struct(p.alias("start"), (p + t["span"]).alias("end"), (F.size(F.array_intersect(t["words"], block)) / F.size(t["words"])).alias("share"), t["label"].alias("label"), t["template"].alias("template"))))

        places = F.array_compact(F.transform(words, lambda w, i: F.when(F.array_contains(t["words"], w), i)))
        return F.array_compact(F.transform(let(places, starts), judged))

    def _close(t: Column, block: Column) -> Column:
        """Block and template meet first in the prefix; what follows there on either side suffices; and so do the sets."""
        first = F.element_at(F.array_intersect(t["prefix"], block), 1)
        rest = F.least(F.size(t["words"]) - F.array_position(t["words"], first), F.size(block) - F.array_position(block, first)) + 1
        return (F.size(F.array_intersect(t["prefix"], block)) > 0) & (rest >= t["need"]) & (F.size(F.array_intersect(t["words"], block)) >= t["need"])

    # So many blocks can start within reach of another.
    around = len(sets) * max((t.span for t in sets), default=1)

    def strongest(found: Column) -> Column:
        near = lambda i: F.slice(found, F.greatest(i + 1 - around, F.lit(1)), F.lit(2 * around + 1))
        beaten = lambda m, i: F.exists(near(i), lambda n: ((n["share"] > m["share"]) | (n["share"] == m["share"]) & F.array_contains(F.get(larger, m["template"]), n["template"])) & (n["start"] < m["end"]) & (m["start"] < n["end"]))
        return F.filter(found, lambda m, i: ~beaten(m, i))

    def matches(met: Column) -> Column:
        return F.array_sort(F.flatten(F.transform(F.filter(side, lambda t: F.arrays_overlap(t["prefix"], met)), blocks)))

    if not sets:
        return F.array().cast(_MATCH)
    likely = F.arrays_overlap(words, firsts)
    return F.when(likely, let(let(F.array_intersect(words, firsts), matches), strongest).cast(_MATCH)).otherwise(F.array().cast(_MATCH))
