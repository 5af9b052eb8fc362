"""Brute-force answers that several tests of this folder hold operators against."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def near_truth(rows, similarity=75):
    sets = {}
    for i, t in rows:
        w = SPACED.findall(fold(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def decontamination_truth(docs, items, n=10):
    windows = defaultdict(set)
    for name, t in items:
        w = ALNUM.findall(fold(t))
        size = min(n, len(w))
        for k in range(len(w) - size + 1) if size else ():
            windows[tuple(w[k : k + size])].add(name)
    sizes = {len(g) for g in windows}
    for t in docs:
        w = ALNUM.findall(fold(t))
        hit, names = np.zeros(len(w), bool), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit[k : k + size] = True
                    names |= found
        yield len(w), int(hit.sum()), sorted(str(x) for x in names if x is not None)
