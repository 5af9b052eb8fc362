"""Masks of noteheads on drawn pages."""

from __future__ import annotations

import numpy as np

from tidemark.operators import raster


def drawn(heads, bars=(), words=(), endless=()):
    """Two staves of five lines, 12 pixels apart; filled heads with stems up of 40 pixels."""
    page = np.full((330, 500), 255, dtype=np.uint8)
    for top in (60, 200):
        for line in range(5):
            page[top + 12 * line : top + 12 * line + 2, 20:480] = 0
    y, x = np.mgrid[: page.shape[0], : page.shape[1]]
    for cx, cy in [*heads, *words, *endless]:
        page[((x - cx) / 8.0) ** 2 + ((y - cy) / 6.0) ** 2 <= 1] = 0
    for cx, cy in heads:
        page[cy - 40 : cy, cx + 6 : cx + 8] = 0
    for cx, cy in endless:
        page[cy - 110 : cy, cx + 6 : cx + 8] = 0
    for b in bars:
        page[60:110, b : b + 2] = 0
    return page


def components_truth(mask):
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        stack, part = [left.pop()], []
        while stack:
            y, x = stack.pop()
            part.append((y, x))
            for d in [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if (y + d[0], x + d[1]) in left:
                    left.remove((y + d[0], x + d[1]))
                    stack.append((y + d[0], x + d[1]))
        ys, xs = zip(*part)
        out.append((min(xs), min(ys), max(xs), max(ys), len(part)))
    return sorted(out)


def test_components_and_erosion_agree_with_pixels():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        mask = rng.random((25, 31)) < share
        assert sorted(raster.components_of(mask)) == components_truth(mask)
        for size in (3, 5):
            arm = size // 2
            padded = np.pad(mask, arm)
            want = np.array([[padded[y : y + size, x : x + size].all() for x in range(31)] for y in range(25)])
            assert (raster._eroded(mask, size) == want).all()
    assert raster.components_of(np.zeros((4, 4), bool)) == []


def test_heads_and_stems_go_and_lines_stay(spark):
    heads = [(100, 90), (160, 84), (220, 230), (300, 108)]
    page = drawn(heads, bars=(400,), words=[(250, 20)], endless=[(340, 300)])
    rows = spark.createDataFrame([(1, 500, 330, page.tobytes()), (2, 500, 330, np.full((330, 500), 255, np.uint8).tobytes())], "k int, w int, h int, p binary")
    got = {r["k"]: r for r in raster.noteheads(rows, "k", "w", "h", "p").collect()}
    after = np.frombuffer(bytes(got[1]["pixels"]), np.uint8).reshape(330, 500)
    centres = sorted(((h["left"] + h["right"]) // 2, (h["top"] + h["bottom"]) // 2) for h in got[1]["heads"])
    # neither a letter above the staff nor a head whose stem is too long for one
    assert len(centres) == 4 and all(abs(a - c) <= 2 and abs(b - d) <= 2 for (a, b), (c, d) in zip(centres, heads))
    assert (after >= page).all() and got[1]["masked"] == int((after != page).sum()) > 400
    for cx, cy in heads:
        assert after[cy, cx] == 255 and (after[cy - 38 : cy - 8, cx + 6] == 255).mean() > 0.6
    assert (after[60:110, 400] == 0).all() and (after[61, 30:90] == 0).all() and after[20, 250] == 0 and after[300, 340] == 0
    assert (got[2]["heads"], got[2]["masked"]) == ([], 0)


def test_columns_of_bar_lines_keep_their_ink(spark):
    page = drawn([(100, 90)])
    rows = spark.createDataFrame([(1, 500, 330, page.tobytes())], "k int, w int, h int, p binary")
    kept = spark.createDataFrame([(1, 106)], "k int, x int")
    after = np.frombuffer(bytes(raster.noteheads(rows, "k", "w", "h", "p", kept).first()["pixels"]), np.uint8).reshape(330, 500)
    assert (after[:, 103:110] == page[:, 103:110]).all() and after[90, 98] == 255
    small, heads = raster.mask_noteheads(page, 5.0, [(60, 110)])
    assert heads == [] and (small == page).all()
