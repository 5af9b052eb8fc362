"""Page rasters: staff systems and bar lines from pixel evidence.

A page is one binary row of grey values; its evidence becomes long rows
(system, x, ...), and candidates are windows over x. Peaks that are too close
are thinned by ``windows.suppress``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ready

from .windows import suppress

#: Grey below which a pixel is dark; share of a row that makes it a staff line.
DARK, LINE = 128, 0.5


def systems_of(page: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(top, bottom, left, right, space) of each staff of five evenly spaced lines."""
    dark = page < DARK
    rows = np.flatnonzero(dark.mean(1) >= LINE)
    if not len(rows):
        return []
    lines = [int(g.mean()) for g in np.split(rows, np.flatnonzero(np.diff(rows) > 1) + 1)]
    out, k = [], 0
    while k + 5 <= len(lines):
        gaps = np.diff(lines[k : k + 5])
        if gaps.max() <= 1.5 * gaps.min() and gaps.min() > 1:
            x = np.flatnonzero(dark[lines[k]])
            out.append((lines[k], lines[k + 4], int(x[0]), int(x[-1]), float(gaps.mean())))
            k += 5
        else:
            k += 1
    return out


def columns(pages: DataFrame, key: str, width: str, height: str, pixels: str) -> DataFrame:
    """Column evidence (system, x, dark, beside) of each page: the dark share
    between a system's outer lines, and the brightness next to it."""
    ready(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, w, h, data in zip(b[key], b[width], b[height], b[pixels], strict=True):
                page = np.frombuffer(bytes(data), dtype=np.uint8).reshape(h, w)
                for s, (top, bottom, left, right, space) in enumerate(systems_of(page)):
                    part = page[top : bottom + 1, left : right + 1] < DARK
                    yield pd.DataFrame({key: k, "system": s, "x": np.arange(left, right + 1), "dark": part.mean(0), "run": _longest(part), "space": space})

    return pages.select(key, width, height, pixels).mapInPandas(run, f"{key} {kind}, system int, x int, dark double, run double, space double")


def _longest(part: np.ndarray) -> np.ndarray:
    """Longest dark run of each column, as a share of its height."""
    best, now = np.zeros(part.shape[1]), np.zeros(part.shape[1])
    for row in part:
        now = np.where(row, now + 1, 0)
        best = np.maximum(best, now)
    return best / max(1, len(part))


def bars(evidence: DataFrame, key: str, strength: float = 0.9, contrast: float = 0.3) -> DataFrame:
    """Bar lines (system, x, dark): columns dark through the system, darker than what lies beside, strongest first."""
    w = Window.partitionBy(key, "system").orderBy("x")
    most = F.max("dark").over(Window.partitionBy(key, "system"))
    left, right = F.min("dark").over(w.rowsBetween(-4, -1)), F.min("dark").over(w.rowsBetween(1, 4))
    peaks = evidence.withColumns({"_m": most, "_l": F.coalesce(left, F.lit(0.0)), "_r": F.coalesce(right, F.lit(0.0))})
    peaks = peaks.where((F.col("dark") >= strength * F.col("_m")) & (F.col("run") >= strength) & (F.col("dark") - F.col("_l") >= contrast) & (F.col("dark") - F.col("_r") >= contrast))
    return suppress(peaks.withColumn("x", F.col("x").cast("double")).withColumn("place", F.col("x") / F.col("space")), [key, "system"], "place", "dark", 0.6)


def measures(bar_lines: DataFrame, key: str) -> DataFrame:
    """Rectangles between neighbouring bar lines: (system, number, from, to)."""
    w = Window.partitionBy(key, "system").orderBy("place")
    return bar_lines.withColumns({"to": F.lead("place").over(w), "number": F.row_number().over(w)}).where("to IS NOT NULL").select(key, "system", "number", F.col("place").alias("from"), "to")


def skew_of(page: np.ndarray, reach: float = 3.0, step: float = 0.25) -> float:
    """Degrees by which a page leans: of slants within reach, the one along which dark pixels fall into the sharpest rows."""
    y, x = np.nonzero(page < DARK)
    if not len(y):
        return 0.0
    best = (-1.0, 0.0, 0.0)
    for angle in np.arange(-reach, reach + step / 2, step):
        rows = np.round(y - x * np.tan(np.radians(angle))).astype(int)
        share = np.bincount(rows - rows.min()).astype(float)
        best = max(best, (float((share**2).sum()), -abs(float(angle)), float(angle)))
    return round(best[2], 2)


def skews(pages: DataFrame, key: str, width: str, height: str, pixels: str) -> DataFrame:
    """(key, degrees) of each page; a page without dark pixels leans by 0."""
    ready(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "degrees": [skew_of(np.frombuffer(bytes(p), dtype=np.uint8).reshape(h, w)) for w, h, p in zip(b[width], b[height], b[pixels], strict=True)]})

    return pages.select(key, width, height, pixels).mapInPandas(run, f"{key} {kind}, degrees double")


#: Fixed values of notehead masks: least staff space, share of the page's mean that is dark and of that which is a core, pixels of a core and its fill.
LEAST_SPACE, DARKER, CORE, LEAST_PIXELS, FILLED = 7.0, 0.7, 0.55, 8, 0.4
#: Staff spaces around a staff, of the largest head, of a stem's width and of the longest stem; pixels of a row that a line crosses, and that a stem may start away.
AROUND, HEAD, STEM, LONGEST_STEM, ACROSS, AWAY = 2.5, 2.0, 0.5, 6.0, 20, 10


def _eroded(dark: np.ndarray, size: int) -> np.ndarray:
    """Pixels around which a square of that size is dark; beyond the page nothing is."""
    arm = size // 2
    for axis in (1, 0):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (arm + 1, arm)
        sums = np.cumsum(np.pad(dark.astype(np.int32), pad), axis=axis)
        dark = (np.take(sums, range(size, sums.shape[axis]), axis) - np.take(sums, range(0, sums.shape[axis] - size), axis)) == size
    return dark


def _runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of a mask's rows, in order."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def components_of(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(left, top, right, bottom, pixels) of each part of a mask that hangs together, corners included: runs of neighbour rows, joined by union-find."""
    row, first, last = _runs_of(mask)
    root = list(range(len(row)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    begins = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in np.unique(row[row > 0]).tolist():
        above = slice(begins[y - 1], begins[y])
        for k in range(begins[y], begins[y + 1]):
            lo = begins[y - 1] + int(np.searchsorted(last[above], first[k] - 1))
            hi = begins[y - 1] + int(np.searchsorted(first[above], last[k] + 1, "right"))
            for j in range(lo, hi):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for k in range(len(row)):
        groups.setdefault(find(k), []).append(k)
    return [(int(first[g].min()), int(row[g].min()), int(last[g].max()), int(row[g].max()), int((last[g] - first[g] + 1).sum())) for g in groups.values()]


def _extents(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last column of the run that each pixel of a mask is in; beyond all columns where it is in none."""
    row, first, last = _runs_of(mask)
    lo, hi = np.full(mask.shape, mask.shape[1]), np.full(mask.shape, 2 * mask.shape[1])
    for y, a, z in zip(row.tolist(), first.tolist(), last.tolist()):
        lo[y, a : z + 1], hi[y, a : z + 1] = a, z
    return lo, hi


def mask_noteheads(page: np.ndarray, space: float, staves: list[tuple[float, float]], kept: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The page without noteheads and their stems, and the boxes of the heads' cores.

    A core is what an erosion leaves of a head and not of lines: small, filled,
    and near a staff (top, bottom). Stems are followed from it through narrow ink,
    across lines, to white or to a beam. A head goes with all of its stems or not
    at all: one whose stem has no end within reach stays. Columns that ``kept``
    names (bar lines found before) keep their ink. Ink is only ever taken away.
    """
    page = page.copy()
    height, width = page.shape
    if space < LEAST_SPACE or min(page.shape) < 16:
        return page, []
    limit = float(page.ravel()[::16].mean()) * DARKER
    dark, core = page < limit, page < limit * CORE
    size = 7 if space > 10 else 5
    arm, widest = size // 2, max(3, round(STEM * space) + 1)
    (lo, hi), (core_lo, core_hi) = _extents(dark), _extents(core)
    dark_wide, core_wide = hi - lo + 1, np.where(core, core_hi - core_lo + 1, width)
    heads, gone = [], np.zeros(page.shape, dtype=bool)
    for x0, y0, x1, y1, pixels in components_of(_eroded(dark, size)):
        w, h, middle = x1 - x0 + 1, y1 - y0 + 1, (y0 + y1) / 2
        if not 2 <= min(w, h) <= max(w, h) <= HEAD * space or pixels < LEAST_PIXELS or pixels / (w * h) < FILLED:
            continue
        if staves and not any(top - AROUND * space <= middle <= bottom + AROUND * space for top, bottom in staves):
            continue
        inside = (max(0, y0 - 1), min(height - 1, y1 + 1))
        stems = [_stem(x, inside[0] - 1 if way < 0 else inside[1] + 1, way, dark, dark_wide, core_wide, widest, int(LONGEST_STEM * space)) for x in range(max(0, x0 - arm - 1), min(width - 1, x1 + arm + 1) + 1) for way in (-1, 1)]
        if any(s is None for s in stems):
            continue
        gone[inside[0] : inside[1] + 1, max(0, x0 - 1) : x1 + 2] = True
        for y, x in (spot for s in stems for spot in s):
            gone[y, lo[y, x] : hi[y, x] + 1] = True
        heads.append((x0, y0, x1, y1))
    if kept is not None:
        gone[:, kept] = False
    page[gone] = 255
    return page, heads


def _stem(x: int, y: int, way: int, dark: np.ndarray, dark_wide: np.ndarray, core_wide: np.ndarray, widest: int, longest: int) -> list[tuple[int, int]] | None:
    """Places of a stem's rows from (x, y) on, none if no stem starts there, or null if it doesn't end within reach."""
    column = slice(y, None, 1) if way > 0 else slice(y, None, -1)
    if not 0 <= y < len(dark):
        return []
    ink, wide, thick = dark[column, x], dark_wide[column, x], core_wide[column, x]
    starts = np.flatnonzero(ink[:AWAY] & (thick[:AWAY] <= widest))
    if not len(starts):
        return []
    a = int(starts[0])
    ink, wide, thick = ink[a : a + longest], wide[a : a + longest], thick[a : a + longest]
    over = ~ink | ((wide <= ACROSS) & (thick > widest))
    if not over.any():
        return None
    rows = np.flatnonzero(wide[: int(over.argmax())] <= ACROSS)
    return [(y + way * (a + int(k)), x) for k in rows]


def noteheads(pages: DataFrame, key: str, width: str, height: str, pixels: str, kept: DataFrame | None = None) -> DataFrame:
    """(heads, masked, pixels) of each page: boxes of the cores, pixels that went white, and the page without them.

    ``kept`` (x) are columns of bar lines, which keep their ink three pixels
    around. A page without staves has no heads.
    """
    ready(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    spared = kept.groupBy(key).agg(F.collect_set(F.col("x").cast("int")).alias("_kept")) if kept is not None else None
    held = pages.select(key, width, height, pixels)
    held = held.join(spared, key, "left") if spared is not None else held.withColumn("_kept", F.array().cast("array<int>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, w, h, data, columns_ in zip(b[key], b[width], b[height], b[pixels], b["_kept"], strict=True):
                page = np.frombuffer(bytes(data), dtype=np.uint8).reshape(h, w)
                staves = systems_of(page)
                stay = np.zeros(w, dtype=bool)
                for x in columns_ if columns_ is not None else ():
                    stay[max(0, x - 3) : x + 4] = True
                after, heads = mask_noteheads(page, float(np.mean([s[4] for s in staves])), [s[:2] for s in staves], stay) if staves else (page, [])
                out.append((k, [dict(zip(("left", "top", "right", "bottom"), x)) for x in heads], int((after != page).sum()), after.tobytes()))
            yield pd.DataFrame(out, columns=[key, "heads", "masked", "pixels"])

    return held.mapInPandas(run, f"{key} {kind}, heads array<struct<left: int, top: int, right: int, bottom: int>>, masked long, pixels binary")
