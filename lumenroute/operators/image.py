"""Image operators on pixel arrays: margins, foreground masks, preset crops, colour identity.

Decoding files and recognising text need libraries that may be absent; they are
plug-ins (see ``sources.plugins``). These functions take decoded pixels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CROP_PRESETS = {"tilted_scan.jpg": (0.08, 0.06, 0.92, 0.96)}


def _shifted(mask: np.ndarray, grow: bool) -> np.ndarray:
    padded = np.pad(mask, 1, constant_values=not grow)
    views = [padded[y : y + mask.shape[0], x : x + mask.shape[1]] for y in range(3) for x in range(3)]
    return np.logical_or.reduce(views) if grow else np.logical_and.reduce(views)


def _row_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of set pixels in each row, in order: row, first column, column after the last."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edges == 1)
    return row, first, np.nonzero(edges == -1)[1]


def _touching(row: np.ndarray, first: np.ndarray, stop: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs in neighbouring rows that touch, also by a corner."""
    begin = np.searchsorted(row, np.arange(height + 2))
    wide = int(stop.max()) + 2
    at, end = row * wide + first, row * wide + stop
    # of the runs in the row below: the first that ends at this one's beginning or later, up to the last that begins at its end or earlier
    low = np.maximum(np.searchsorted(end, (row + 1) * wide + first), begin[row + 1])
    high = np.minimum(np.searchsorted(at, (row + 1) * wide + stop, "right"), begin[row + 2])
    n = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(row)), n)
    return upper, np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def largest_component(mask: np.ndarray) -> tuple[np.ndarray | None, int, tuple[int, int, int, int]]:
    """The largest 8-connected region, its area and its box (x, y, width, height); of equal ones the first from the top left.

    Runs of rows are the nodes; their least labels spread along touching runs, halving paths, until nothing changes.
    """
    row, first, stop = _row_runs(mask)
    if not len(row):
        return None, 0, (0, 0, 0, 0)
    a, b = _touching(row, first, stop, mask.shape[0])
    label = np.arange(len(row))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    area = np.bincount(label, stop - first)
    best = int(area.argmax())
    mine = np.flatnonzero(label == best)
    region = np.zeros(mask.shape, bool)
    for r, c, d in zip(row[mine], first[mine], stop[mine], strict=True):
        region[r, c:d] = True
    x, y = int(first[mine].min()), int(row[mine].min())
    return region, int(area[best]), (x, y, int(stop[mine].max()) - x, int(row[mine].max()) - y + 1)


def foreground(image: np.ndarray, white: int = 244) -> np.ndarray:
    """What isn't paper: pixels unlike the border's median colour, or dark; its dominant region unless that is implausibly small."""
    px = (image if image.ndim == 3 else image[:, :, None]).astype(np.int16)
    h, w = px.shape[:2]
    frame = np.concatenate([px[0], px[-1], px[:, 0], px[:, -1]])
    paper = np.median(frame, axis=0).astype(np.int16)
    noise = np.percentile(np.abs(frame - paper).max(1), 80)
    dark = (px < white).any(2)
    marked = (np.abs(px - paper).max(2) >= min(8, max(3, int(noise)))) | dark
    for grow in (False, True, True, False):  # opening, then closing
        marked = _shifted(marked, grow)
    region, area, (_, _, rw, rh) = largest_component(marked)
    if region is None or area < 0.2 * w * h or rw < 0.4 * w or rh < 0.6 * h:
        return dark
    return region


def trim(image: np.ndarray, white: int = 244, padding: int = 6) -> tuple[int, int, int, int]:
    """The rectangle (x1, y1, x2, y2), inclusive, of the foreground with padding; the whole image if over 97 % would stay."""
    kept = _extent(foreground(image, white))
    h, w = image.shape[:2]
    if kept is None or _share(kept, image) > 0.97:
        return 0, 0, w - 1, h - 1
    (left, right), (top, bottom) = kept
    pad = max(0, padding)
    return max(0, left - pad), max(0, top - pad), min(w - 1, right + pad), min(h - 1, bottom + pad)


def _extent(mask: np.ndarray) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """The first and last column, and the first and last row, with a set pixel."""
    found = tuple(np.flatnonzero(mask.any(axis)) for axis in (0, 1))
    return None if not len(found[0]) else tuple((int(f[0]), int(f[-1])) for f in found)


def _share(extent, image: np.ndarray) -> float:
    (left, right), (top, bottom) = extent
    return (right - left + 1) * (bottom - top + 1) / (image.shape[0] * image.shape[1])


def trim_margins(image: np.ndarray, white: int = 244, least_shrink: float = 0.04, padding: int = 6) -> np.ndarray:
    """The image without white margins, if they take up enough of it and it isn't tiny."""
    inked = image < white
    kept = _extent(inked if inked.ndim == 2 else inked.any(2))
    if min(image.shape[:2]) < 40 or kept is None or 1 - _share(kept, image) < least_shrink:
        return image
    (left, right), (top, bottom) = kept
    return image[max(0, top - padding) : bottom + 1 + padding, max(0, left - padding) : right + 1 + padding]


def reference_crop(rect: Column, width: Column, height: Column) -> Column:
    """What a reference image's rectangle (x1, y1, x2, y2), inclusive, says: sizes, margins and aspect ratio."""
    x1, y1, x2, y2 = (rect[k] for k in range(4))
    w, h = x2 - x1 + 1, y2 - y1 + 1
    named = {"orig_w": width, "orig_h": height, "crop_w": w, "crop_h": h, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "left": x1, "top": y1, "right": width - 1 - x2, "bottom": height - 1 - y2}
    return F.struct(*(c.cast("int").alias(k) for k, c in named.items()), (w / h).alias("aspect"))


def brightness_factor(median: int, last: int | None, target: int = 128, alpha: float = 0.1) -> tuple[float, int]:
    """By how much to scale a frame's brightness, and the smoothed median that is carried to the next frame."""
    smooth = int(alpha * median + (1 - alpha) * (median if last is None else last))
    return (target / smooth if smooth > 0 else 1.0), smooth


def scaled(values: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(values.astype(np.float32) * factor, 0, 255).astype(np.uint8)


def smoothed(before: np.ndarray | None, now: np.ndarray, alpha: float) -> np.ndarray:
    """A frame blended with the one shown before."""
    return now if before is None or alpha <= 0 else np.clip(np.rint(alpha * before.astype(np.float32) + (1 - alpha) * now), 0, 255).astype(np.uint8)


def warped(pixels: np.ndarray, warp: Callable[[np.ndarray], np.ndarray | None] | None) -> np.ndarray:
    """The card cut out by a ``warp`` plug-in, at most 745 x 1043, or the image where there is none or it finds nothing."""
    found = warp(pixels) if warp is not None else None
    return pixels if found is None or not found.size else found[:1043, :745]


def text_hints(pixels: np.ndarray, top_band: Callable[[np.ndarray], dict], bottom_band: Callable[[np.ndarray], dict], warp: Callable[[np.ndarray], np.ndarray | None] | None = None) -> dict:
    """What text recognition, two plug-ins, finds in the bands of a card cut out by its border; the bottom band's answers come last and win."""
    card = warped(pixels, warp)
    return {**top_band(card), **bottom_band(card)}


def whole_text(text: Column) -> Column:
    """A recognised full text as a rules text: at least 40 characters, and the first 1800 of them."""
    return F.when(F.length(F.trim(text)) >= 40, F.substring(F.trim(text), 1, 1800))


def circle_cost(pixels: np.ndarray, circles: Callable[[np.ndarray], int]) -> int | None:
    """A cost by the number of circles, counted by a plug-in, in the top right of a card; only 1 to 12 are believed."""
    h, w = pixels.shape[:2]
    y, x = int(h * 0.02), int(w * 0.55)
    n = circles(pixels[y : max(y + 1, int(h * 0.18)), x : max(x + 1, int(w * 0.96))])
    return n if 1 <= n <= 12 else None


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def trim_rect(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """``trim`` for RGB bytes row by row; null where the bytes don't fit the size."""
    out = []
    for raw, h, w in zip(data, height, width, strict=True):
        fits = raw is not None and h > 0 and w > 0 and len(raw) == h * w * 3
        out.append(list(trim(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3))) if fits else None)
    return pd.Series(out)


def preset_crop(file: Column, width: Column, height: Column, presets: dict[str, tuple[float, float, float, float]] | None = None) -> Column:
    """The preset crop (x1, y1, x2, y2), end exclusive, of a file known by name; null for others."""
    out = F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>")
    for name, (x1, y1, x2, y2) in (CROP_PRESETS if presets is None else presets).items():
        near = lambda size, share: F.rint(size * F.lit(share)).cast("int")
        a, b = F.greatest(F.lit(0), F.least(width - 1, near(width, x1))), F.greatest(F.lit(0), F.least(height - 1, near(height, y1)))
        rect = F.struct(a.alias("x1"), b.alias("y1"), F.greatest(a + 1, F.least(width, near(width, x2))).alias("x2"), F.greatest(b + 1, F.least(height, near(height, y2))).alias("y2"))
        out = F.when(F.lower(file) == name, rect).otherwise(out)
    return out


def colour_shares(hsv: np.ndarray) -> dict[str, float]:
    """Shares of pixels that look white, blue, black, red and green (hue 0..179, saturation and value 0..255)."""
    h, s, v = (hsv[..., k].astype(int) for k in range(3))
    vivid = (s > 60) & (v > 50)
    masks = {"W": (s < 40) & (v > 200), "U": vivid & (h >= 90) & (h <= 130), "B": v < 50, "R": vivid & ((h <= 10) | (h >= 170)), "G": vivid & (h >= 40) & (h <= 85)}
    return {k: float(m.mean()) if m.size else 0.0 for k, m in masks.items()}


def strip_feature(grey: np.ndarray, share: float = 0.15, width: int = 32, height: int = 8) -> np.ndarray:
    """A vector of the top strip's brightness, for nearest-neighbour lookup."""
    top = grey[: max(1, int(round(grey.shape[0] * share)))].astype(np.float64)
    rows, cols = np.linspace(0, top.shape[0], height + 1).astype(int), np.linspace(0, top.shape[1], width + 1).astype(int)
    cells = [[top[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:], strict=False)] for a, b in zip(rows, rows[1:], strict=False)]
    flat = np.array(cells).ravel()
    return flat / max(np.linalg.norm(flat), 1e-9)
