"""Lesion candidates of an image: even shading, take vessels away, threshold, join to spots; all in one kernel.

Dark spots (microaneurysms, haemorrhages) stand out from a closing of their own size; pale and yellow ones
(cotton-wool spots, exudates) from ratios of colours against their surroundings, never from colours alone.
Nothing here is fitted, so candidates serve every fold of a cross-validation.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from . import filters as P
from .images import per_image
from .kernels import label

#: Fixed values, in pixels at a retina of 436 pixels' radius.
CLOSING_LENGTH = {"ma": 15, "haem": 41}
SMALL_PERCENTILE = {"ma": 99.0, "haem": 96.0}
LARGEST_MA = math.pi * (125.0 / (1850.0 / 124) / 2) ** 2
AREAS = {"ma": (3.0, LARGEST_MA), "haem": (LARGEST_MA, math.pi * 17.0**2)}
ORIENTATIONS = 12
SMALL_VESSEL_GROWTH = 3
LEAST_GAP = 1e-4
SHADE_SHARE = 0.10
VESSEL_GROWTH = 3
TOP_HAT_PERCENTILE = 95.0
RATIO_WINDOW, SURROUNDINGS = 9, 27
YELLOW_SATURATION = 0.35
BLUE_GREEN_DEVIATION = 0.05
LEAST_AREA = 3
DISC_COVER, FOVEA_COVER = 1.2, 0.5


def shade_corrected(green: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Green less its background, a blur as wide as a tenth of the height, plus the mean of the valid pixels."""
    sigma = max(round(len(green) * SHADE_SHARE), 3) / 3.0
    ground = P.gaussian(green, sigma, int(round(sigma * 8 + 1) // 2), "mirror")
    return green - ground + float(green[valid].mean() if valid.any() else green.mean())


def without_vessels(mask: np.ndarray, vessels: np.ndarray, growth: int = VESSEL_GROWTH) -> np.ndarray:
    """``mask`` less the vessels, grown by a disc so that their edges go as well."""
    return mask & ~P.grown(vessels, growth)


def least_closing(levels: np.ndarray, length: int) -> np.ndarray:
    """The least of the closings along lines: only what some single line bridges is filled.  Levels are whole, 0..255."""
    if np.isfinite(levels).all():
        levels = levels.astype(np.uint8)
    return np.minimum.reduce([P.closed(levels, P.line_support(length, 180.0 * k / ORIENTATIONS)) for k in range(ORIENTATIONS)])


def small_dark(shade: np.ndarray, vessels: np.ndarray, view: np.ndarray, length: int, percentile: float) -> np.ndarray:
    """Pixels of an image of 0..1 that a closing lifts more than the percentile of the view, away from vessels."""
    levels = np.floor(np.clip(shade, 0, 1) * 255)
    gap = (least_closing(levels, length).astype(np.float64) - levels) / 255.0
    grown = P.extreme(vessels, np.ones((2 * SMALL_VESSEL_GROWTH + 1,) * 2, dtype=bool), True)
    gap = np.where(grown | ~view, 0.0, gap)
    if not (gap > 0).any() or not view.any():
        return np.zeros(gap.shape, dtype=bool)
    return gap > max(P.percentile(gap[view], percentile), LEAST_GAP)


def top_hat(corrected: np.ndarray, mask: np.ndarray, length: int, percentile: float = TOP_HAT_PERCENTILE) -> np.ndarray:
    """Pixels that a closing by a disc lifts more than the percentile of the mask."""
    gap = P.closed(corrected, P.ellipse(length)) - corrected
    return (gap > P.percentile(gap[mask], percentile)) & mask if mask.any() else np.zeros(gap.shape, dtype=bool)


def saturation(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
    """Spread of the colours over the largest, 0..1 in 255ths."""
    most, least = np.maximum(np.maximum(red, green), blue), np.minimum(np.minimum(red, green), blue)
    share = np.rint(255 * 4096 / np.where(most == 0, 1, most))
    return np.where(most == 0, 0, np.floor(((most - least) * share + 2048) / 4096)) / 255.0


def ratio_spots(red: np.ndarray, green: np.ndarray, blue: np.ndarray, mask: np.ndarray, lesion: str) -> np.ndarray:
    """Pixels whose local colour ratios deviate as the lesion's do."""
    if lesion == "hard_exudate":
        return (P.box_mean(saturation(red, green, blue), RATIO_WINDOW) > YELLOW_SATURATION) & mask
    ratio = P.box_mean(blue, RATIO_WINDOW) / (P.box_mean(green, RATIO_WINDOW) + 1e-6)
    over = ratio - P.box_mean(ratio, SURROUNDINGS)
    return ((over if lesion == "cws" else -over) > BLUE_GREEN_DEVIATION) & mask


def spots(mask: np.ndarray, connectivity: int, least: float, most: float = math.inf) -> list[tuple[float, float, int]]:
    """(cx, cy, area) of the joined groups of pixels, in the order of their first pixels."""
    labels, n = label(mask, connectivity)
    y, x = np.nonzero(labels)
    of = labels[y, x] - 1
    area = np.bincount(of, minlength=n)
    cy, cx = np.bincount(of, y, n) / np.maximum(area, 1), np.bincount(of, x, n) / np.maximum(area, 1)
    return [(float(cx[k]), float(cy[k]), int(area[k])) for k in range(n) if least <= area[k] <= most]


def covered(size: tuple[int, int], x: float, y: float, radius: int) -> np.ndarray:
    rows, columns = np.mgrid[0 : size[0], 0 : size[1]]
    return (rows - round(y)) ** 2 + (columns - round(x)) ** 2 <= radius**2


def searches(
    red: np.ndarray, green: np.ndarray, blue: np.ndarray, shade: np.ndarray, vessels: np.ndarray, view: np.ndarray, disc: tuple[float, float, float], fovea: tuple[float, float]
) -> list[tuple[str, np.ndarray, int, tuple[float, float], np.ndarray]]:
    """(lesion, pixels, how they join, areas allowed, the evened green of 0..255 to measure them on) of all four kinds.

    The image has levels 0..255; ``shade`` is the evened green of 0..1.
    """
    found = []
    for lesion in ("ma", "haem"):
        dark = small_dark(shade, vessels, view, CLOSING_LENGTH[lesion], SMALL_PERCENTILE[lesion])
        found.append((lesion, dark, 4, AREAS[lesion], shade * 255.0))
    free = view & ~covered(view.shape, disc[0], disc[1], max(round(disc[2] * DISC_COVER), 1)) & ~covered(view.shape, *fovea, max(round(2 * disc[2] * FOVEA_COVER), 1))
    corrected = shade_corrected(green, free)
    free = without_vessels(free, vessels)
    for lesion in ("hard_exudate", "cws"):
        found.append((lesion, ratio_spots(red, green, blue, free, lesion), 8, (LEAST_AREA, math.inf), corrected))
    return found


def candidates(
    red: np.ndarray, green: np.ndarray, blue: np.ndarray, shade: np.ndarray, vessels: np.ndarray, view: np.ndarray, disc: tuple[float, float, float], fovea: tuple[float, float]
) -> list[tuple[str, float, float, int]]:
    """(lesion, cx, cy, area) of all four kinds in an image of levels 0..255; ``shade`` is the evened green of 0..1."""
    return [(lesion, *s) for lesion, mask, joined, areas, _ in searches(red, green, blue, shade, vessels, view, disc, fovea) for s in spots(mask, joined, *areas)]


def candidate_rows(images: DataFrame, key: str, size: int, scale: object = None) -> DataFrame:
    """(key, lesion, cand, cx, cy, area), one row a candidate, from (key, red, green, blue, od_x, od_y, od_radius, fovea_x, fovea_y).

    Colours are row-major arrays of ``size`` x ``size`` levels 0..255; the vessels that are taken away are those of the
    vessel map.  cand counts an image's candidates of a lesion from 1.  Images without pixels, disc or fovea make no row.
    """
    from . import vessels as V

    s = scale or V.Scale()
    marks = ["od_x", "od_y", "od_radius", "fovea_x", "fovea_y"]

    def kernel(red: np.ndarray, green: np.ndarray, blue: np.ndarray, _key: object, x: float, y: float, radius: float, fx: float, fy: float) -> list[tuple]:
        retina, view = V.round_view(size, s.retina), V.round_view(size, s.measured)
        shade = V.evened(green / 255.0, retina, s)
        matched = V.matched_map(green, retina, s)
        band = V.calibre(V.ridges(green, s)[1], matched, s)
        vessels = matched | np.isin(band, (V.MAJOR, V.FIRST_BRANCH, V.MINOR))
        rows, number = [], {}
        for lesion, cx, cy, area in candidates(red, green, blue, shade, vessels, view, (x, y, radius), (fx, fy)):
            number[lesion] = number.get(lesion, 0) + 1
            rows.append((lesion, number[lesion], cx, cy, float(area)))
        return rows

    return per_image(images.dropna(subset=marks), ["red", "green", "blue"], [key, *marks], size, kernel, "lesion string, cand int, cx double, cy double, area double").drop(*marks)


def bridged(mask: np.ndarray, length: int) -> np.ndarray:
    """``mask`` and those added groups of pixels that join at least two of its parts.

    Pixels are added by closings along lines.  A group of them, joined by sides, stays if its pixels see, each in its
    3 x 3 surroundings the part that begins last, two or more different parts.
    """
    parts, n = label(mask)
    if n < 2:
        return mask
    added = np.zeros(mask.shape, dtype=bool)
    for k in range(ORIENTATIONS):
        added |= P.closed(mask, P.line_support(length, 180.0 * k / ORIENTATIONS))
    groups, m = label(added & ~mask)
    if m == 0:
        return mask
    seen = P.extreme(parts, np.ones((3, 3), dtype=bool), True).astype(int)
    pairs = np.unique(np.stack([groups[groups > 0], seen[groups > 0]]), axis=1)
    joined = np.bincount(pairs[0][pairs[1] > 0], minlength=m + 1) >= 2
    return mask | joined[groups]


def bridge_rows(images: DataFrame, key: str, width: int, length: int, values: str, above: float) -> DataFrame:
    """(key, pixels, added, parts_before, parts_after) of the mask of values above a threshold, its gaps bridged."""

    def kernel(picture: np.ndarray, _key: object) -> list[tuple]:
        mask = picture > above
        out = bridged(mask, length)
        return [(int(mask.sum()), int((out & ~mask).sum()), label(mask)[1], label(out)[1])]

    return per_image(images, [values], [key], width, kernel, "pixels long, added long, parts_before long, parts_after long")
