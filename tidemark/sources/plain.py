"""Plain XML texts, a whole batch at once: their elements as arrays.

A text is plain if it is ASCII without references, comments, declarations, prefixes and carriage returns, its attributes
stand in double quotes, and it is well formed. Any other text is told apart, and left to a parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_USUAL = re.compile(r"[\t\n !-%'-~]*")
_TAG = re.compile(r'(/?)([A-Za-z_][\w.-]*)((?: [A-Za-z_][\w.-]*="[^"\n\t]*")*)( ?/)?', re.ASCII)
_ATTRIBUTE = re.compile(r' ([\w.-]+)="', re.ASCII)


def _piece(piece: str) -> tuple[int, str, str]:
    """Of the text from behind a < up to the next: what the tag does to the depth, its name, and what follows it; without a name it isn't plain."""
    tag, closed, said = piece.partition(">")
    m = _TAG.fullmatch(tag) if closed and ">" not in said and _USUAL.fullmatch(piece) else None
    names = _ATTRIBUTE.findall(m[3]) if m else []
    if not m or (m[1] and (m[3] or m[4])) or len(set(names)) < len(names) or any(n.startswith("xmlns") for n in names):
        return 0, "", ""
    return -1 if m[1] else 0 if m[4] else 1, m[2], said


@dataclass
class Elements:
    """Elements of the plain texts, in order of their first bytes, and the texts as pieces: tags with what follows each."""

    at: np.ndarray  # each text's first byte; one more at the end
    plain: np.ndarray  # of each text
    text: np.ndarray  # number of the text
    name: np.ndarray
    begin: np.ndarray  # first byte
    stop: np.ndarray  # where the closing tag begins; for an element of one tag, its end
    end: np.ndarray  # past the last byte
    parent: np.ndarray  # -1: none
    level: np.ndarray  # 1: the root
    leaf: np.ndarray
    said: np.ndarray  # number, in ``words``, of the text up to the next tag
    said_nothing: int  # the number of the empty text
    words: list[str]
    names: dict[str, int]
    pieces: list[str]  # the distinct ones, without their <
    piece: np.ndarray  # number, in ``pieces``, of each piece of the plain texts
    owner: np.ndarray  # number of each piece's text
    opens: np.ndarray  # an element's first piece
    closes: np.ndarray  # and its last

    def named(self, *names: str) -> np.ndarray:
        asked = np.zeros(len(self.names), dtype=bool)
        asked[[self.names[n] for n in names if n in self.names]] = True
        return asked[self.name]

    def parsed(self, which: np.ndarray, parse, default) -> tuple[np.ndarray, np.ndarray]:
        """``parse`` of the text of these elements, and which failed: each distinct text once."""
        codes, distinct = pd.factorize(self.said[which])
        values, failed = [], np.zeros(len(distinct), dtype=bool)
        for k, code in enumerate(distinct.tolist()):
            try:
                values.append(parse(self.words[code]) if isinstance(default, str) else np.int64(parse(self.words[code])))
            except (ValueError, OverflowError):  # also what numpy can't hold
                values.append(default)
                failed[k] = True
        kind = object if isinstance(default, str) else np.int64
        return np.array(values, dtype=kind)[codes], failed[codes]


def runs(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """(number of the first, texts) of about so many characters: what is held meanwhile is a multiple of that."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= size:
            yield first, texts[first : k + 1]
            first, held = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def elements(texts: list[str | None]) -> Elements:
    split = pc.split_pattern(pa.array([t or "" for t in texts], pa.string()), "<")
    count = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    coded = split.flatten().dictionary_encode()
    # Few pieces are distinct: each is looked into once.
    pieces, piece = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    known, sizes = [_piece(p) for p in pieces], pc.binary_length(coded.dictionary).to_numpy()
    names = {n: k for k, n in enumerate(dict.fromkeys(n for _, n, _ in known))}
    words = {"": 0}
    told = np.array([words.setdefault(s, len(words)) for _, _, s in known], dtype=np.int64)
    fine = np.array([n != "" for _, n, _ in known], dtype=bool)
    text, size = np.repeat(np.arange(len(texts)), count), sizes[piece].astype(np.int64)
    begun = np.cumsum(size + 1) - (size + 1) - text  # first byte of each piece, behind its <
    lead = np.cumsum(count) - count
    inner = np.ones(len(piece), dtype=bool)
    inner[lead] = False
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    at[1:] = np.cumsum(np.bincount(text, weights=size, minlength=len(texts)).astype(np.int64) + count - 1)
    # A plain text begins with a tag and ends with one.
    plain = (count > 1) & (size[lead] == 0)
    plain &= told[piece[lead + count - 1]] == 0
    plain[text[inner & ~fine[piece]]] = False
    kept = np.flatnonzero(inner & plain[text])
    piece, text, size, begun = piece[kept], text[kept], size[kept], begun[kept]
    lt, said = begun - 1, told[piece]
    gt = begun + (sizes - np.array([len(s) + 1 for _, _, s in known], dtype=np.int64))[piece]
    step = np.array([s for s, _, _ in known], dtype=np.int64)[piece]
    name = np.array([names[n] for _, n, _ in known], dtype=np.int64)[piece]
    # The depth of each text starts at 0.
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    total = np.concatenate([[0], np.cumsum(step)])
    depth = total[1:] - total[first[:-1]][text]
    level = depth + (step <= 0)
    plain[text[level < 1]] = False
    plain &= total[first[1:]] == total[first[:-1]]
    plain &= np.bincount(text[level == 1], minlength=len(texts)) == 2
    has = first[1:] > first[:-1]
    plain[has] &= (level[first[:-1][has]] == 1) & (level[first[1:][has] - 1] == 1)
    # An element of text alone closes at once; of the others tags open and close in turn at each level of a text.
    twin, short = np.arange(len(lt)), np.zeros(len(lt), dtype=bool)
    short[:-1] = (step[:-1] == 1) & (step[1:] == -1)
    k = np.flatnonzero(short)
    plain[text[k[name[k] != name[k + 1]]]] = False
    twin[k] = k + 1
    short[k + 1] = True
    pairs = np.flatnonzero((step != 0) & plain[text] & ~short)
    pairs = pairs[np.lexsort((level[pairs], text[pairs]))]
    opens, closes = pairs[::2], pairs[1::2]
    plain[text[opens[name[opens] != name[closes]]]] = False
    twin[opens] = closes
    e = np.flatnonzero((step >= 0) & plain[text])
    last = twin[e]
    parent = np.full(len(e), -1)
    deep = level[e]
    above = np.flatnonzero(deep == 1)
    for k in range(2, int(deep.max(initial=1)) + 1):
        here = np.flatnonzero(deep == k)
        parent[here] = above[np.searchsorted(above, here) - 1]
        above = here
    return Elements(
        at, plain, text[e], name[e], lt[e], np.where(step[e] == 0, gt[e] + 1, lt[last]), gt[last] + 1, parent, deep, (step[e] == 0) | (last == e + 1), np.where(step[e] == 0, 0, said[e]), 0, list(words), names,
        pieces, piece, text, e, last,
    )
