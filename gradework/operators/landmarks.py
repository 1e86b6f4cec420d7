"""Optic disc and fovea of an image, and its row of measures that no lesion classifier touches, in one kernel over its arrays.

The disc is the place and radius whose round surroundings, vessels left out, are brightest; the fovea is the darkest patch in a fan from the disc
towards the middle of the view.  Distances are in disc diameters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters as P
from . import lesion as L
from . import spots as S
from . import vessels as V
from .images import per_image

#: Radii tried and accepted as shares of the view's radius, contrast of a disc, and the fan of the fovea.
SHARES = tuple(np.linspace(0.03, 0.15, 5).tolist())
ACCEPTED = (0.05, 0.12)
LEAST_RADIUS = 3.0
RING = 2.0
LEAST_CONTRAST = 5.0
EXPECTED_DISTANCE = 2.4
FAN_DEGREES, ANGLES = 25.0, 11
REACH, RADII = (0.5, 1.25), 20
PATCH = 6
OUTWARD = (0.15, 0.3)


class Disc(NamedTuple):
    x: float
    y: float
    radius: float
    contrast: float
    confirmed: bool


class Fovea(NamedTuple):
    x: float
    y: float
    darkness: float
    brighter_outward: bool


def brightness(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
    return 0.299 * red + 0.587 * green + 0.114 * blue


def round_means(image: np.ndarray, valid: np.ndarray, radius: float) -> np.ndarray:
    """Mean of the valid pixels in a disc about each pixel; the image's edge goes on beyond the border."""
    return next(all_round_means(image, valid, [radius]))


def all_round_means(image: np.ndarray, valid: np.ndarray, radii: list[float]) -> Iterator[np.ndarray]:
    """``round_means`` for each radius."""
    supports = [P.ellipse(2 * round(radius) + 1).astype(np.float64) for radius in radii]
    for total, number in zip(P.correlated(np.where(valid, image, 0.0), supports, "edge"), P.correlated(valid.astype(np.float64), supports, "edge")):
        yield total / np.maximum(number, 1e-6)


def find_disc(red: np.ndarray, green: np.ndarray, blue: np.ndarray, vessels: np.ndarray, view: np.ndarray) -> Disc:
    """The brightest disc with its middle in the view; its contrast is the distance of its mean colour from that of the ring around it."""
    image = brightness(red, green, blue)
    if view.any():
        y, x = np.nonzero(view)
        view_radius = float(np.ptp(x) + np.ptp(y)) / 4
    else:
        view, view_radius = np.ones(image.shape, dtype=bool), min(image.shape) / 2
    best = None
    radii = list(dict.fromkeys(max(LEAST_RADIUS, share * view_radius) for share in SHARES))
    for radius, found in zip(radii, all_round_means(image, ~vessels, radii)):
        means = np.where(view, found, -np.inf)
        at = int(np.argmax(means))
        if best is None or means.flat[at] > best[0]:
            best = means.flat[at], at, radius
    _, at, radius = best
    cy, cx = divmod(at, image.shape[1])
    inner = S.covered(image.shape, cx, cy, max(round(radius), 1))
    ring = S.covered(image.shape, cx, cy, max(round(radius * RING), 1)) & ~inner
    gaps = [c[inner].mean() - (c[ring].mean() if ring.any() else 0.0) for c in (red, green, blue)]
    contrast = math.sqrt(sum(g * g for g in gaps))
    accepted = ACCEPTED[0] <= (radius / view_radius if view_radius else 0.0) <= ACCEPTED[1]
    return Disc(float(cx), float(cy), radius, contrast, accepted and contrast >= LEAST_CONTRAST)


def _patch(image: np.ndarray, x: float, y: float) -> float:
    """Mean of the square about a point, as much of it as lies in the image."""
    part = image[max(0, int(y - PATCH)) : int(y + PATCH) + 1, max(0, int(x - PATCH)) : int(x + PATCH) + 1]
    return float(part.mean()) if part.size else float(image[min(max(int(y), 0), image.shape[0] - 1), min(max(int(x), 0), image.shape[1] - 1)])


def _patches(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``_patch`` of points in the image."""
    side = 2 * PATCH + 1
    top, left = y.astype(int) - PATCH, x.astype(int) - PATCH
    whole = (top >= 0) & (left >= 0) & (top + side <= image.shape[0]) & (left + side <= image.shape[1]) & (min(image.shape) >= side)
    out = np.empty(len(x))
    if whole.any():
        rows = np.lib.stride_tricks.sliding_window_view(image, (side, side))[top[whole], left[whole]].sum(2)
        total = rows[:, 0].copy()
        for k in range(1, side):  # row after row, as one patch is summed
            total += rows[:, k]
        out[whole] = total / side**2
    for i in np.flatnonzero(~whole).tolist():
        out[i] = _patch(image, float(x[i]), float(y[i]))
    return out


def find_fovea(image: np.ndarray, disc: Disc, view: np.ndarray) -> Fovea:
    """The darkest point of the fan inside image and view, the first among equals; without one the expected place to the right.

    brighter_outward is an independent check: of a true fovea the surroundings are brighter further out.
    """
    h, w = image.shape
    y, x = np.nonzero(view)
    my, mx = (float(y.mean()), float(x.mean())) if len(y) else (h / 2, w / 2)
    axis = math.atan2(my - disc.y, mx - disc.x) if (mx, my) != (disc.x, disc.y) else 0.0
    diameter = 2 * disc.radius
    expected = EXPECTED_DISTANCE * diameter
    r = np.linspace(REACH[0] * expected, REACH[1] * expected, RADII)
    turns = [axis + tilt for tilt in np.radians(np.linspace(-FAN_DEGREES, FAN_DEGREES, ANGLES))]
    px = (disc.x + r * np.array([[math.cos(t)] for t in turns])).ravel()
    py = (disc.y + r * np.array([[math.sin(t)] for t in turns])).ravel()
    inside = (0 <= px) & (px < w) & (0 <= py) & (py < h)
    px, py = px[inside], py[inside]
    seen = view[py.astype(int), px.astype(int)]
    px, py = px[seen], py[seen]
    best = None
    if len(px):
        dark = _patches(image, px, py)
        if not np.isnan(dark).all():
            at = int(np.nanargmin(dark)) if not math.isnan(dark[0]) else 0
            best = float(dark[at]), float(px[at]), float(py[at])
        else:
            best = math.nan, float(px[0]), float(py[0])
    if best is None:
        return Fovea(disc.x + expected, disc.y, math.nan, False)
    dark, fx, fy = best
    away = math.atan2(fy - disc.y, fx - disc.x)
    further = [(fx + k * diameter * math.cos(away), fy + k * diameter * math.sin(away)) for k in OUTWARD]
    seen = np.array([(a, b) for a, b in further if 0 <= a < w and 0 <= b < h]).reshape(-1, 2)
    return Fovea(fx, fy, dark, len(seen) > 0 and bool((_patches(image, seen[:, 0], seen[:, 1]) > dark).all()))


MARKS = ("od_x", "od_y", "od_radius", "od_radius_pct", "od_contrast", "od_confirmed", "fovea_x", "fovea_y", "fovea_darkness", "fovea_checked", "od_fovea_dist_dd")
_MADE = ", ".join(f"{c} {'boolean' if c in ('od_confirmed', 'fovea_checked') else 'double'}" for c in MARKS)


def located(red: np.ndarray, green: np.ndarray, blue: np.ndarray, vessels: np.ndarray, retina: np.ndarray, s: V.Scale) -> tuple[Disc, Fovea, tuple]:
    disc = find_disc(red, green, blue, vessels, retina)
    fovea = find_fovea(brightness(red, green, blue), disc, retina)
    radius = len(green) / 2
    away = math.hypot(fovea.x - disc.x, fovea.y - disc.y) / s.disc_diameter
    dark = None if math.isnan(fovea.darkness) else fovea.darkness
    return disc, fovea, (disc.x, disc.y, disc.radius, 100 * disc.radius / radius, disc.contrast, disc.confirmed, fovea.x, fovea.y, dark, fovea.brighter_outward, away)


def vessel_mask(green: np.ndarray, retina: np.ndarray, s: V.Scale) -> np.ndarray:
    return vessels_of(V.mapped(green, retina, s))


def vessels_of(found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return found[0] | np.isin(found[1], (V.MAJOR, V.FIRST_BRANCH, V.MINOR))


def image_features(images: DataFrame, key: str, size: int, scale: V.Scale = V.Scale()) -> DataFrame:
    """One row an image: (key, landmarks, vessel columns) from (key, red, green, blue), levels 0..255 of a square whose half is the view's radius.

    Nothing here depends on a fitted classifier, so the rows serve every fold.  Images without pixels make no row.
    """

    def kernel(red: np.ndarray, green: np.ndarray, blue: np.ndarray, _key: object) -> list[tuple]:
        marks, measured, *_ = features(red, green, blue, size, scale)
        return [(*marks, *measured)]

    return per_image(images, ["red", "green", "blue"], [key], size, kernel, MADE)


def features(red: np.ndarray, green: np.ndarray, blue: np.ndarray, size: int, scale: V.Scale) -> tuple[tuple, tuple, tuple, tuple]:
    """An image's landmarks, its vessel columns, its vessels as ``vessels.mapped`` tells them, and disc and fovea."""
    retina = V.round_view(size, scale.retina)
    found = V.mapped(green, retina, scale)
    disc, fovea, marks = located(red, green, blue, vessels_of(found), retina, scale)
    out = V.measured(green, (disc.x, disc.y), (fovea.x, fovea.y), scale, disc.radius, found)
    return marks, tuple(out[c] for c in V.VESSEL_COLUMNS), found, (disc.x, disc.y, disc.radius, fovea.x, fovea.y)


MADE = _MADE + ", " + ", ".join(f"{c} {'int' if c in V._WHOLE else 'double'}" for c in V.VESSEL_COLUMNS)


#: Columns of an image's row of the second stage, in their order (fixed values).
STAGE2_COLUMNS = (
    "vessel_density_pct", "vessel_fragmentation", "vessel_components", "vessel_largest_tree_pct", "vessel_length", "vessel_orientation_coherence",
    "major_vessel_pct", "branch1_vessel_pct", "minor_vessel_pct", "venous_beading_pct", "venous_beading_quadrants",
    "nv_score", "nv_score_max", "nvd_score", "nve_score", "nv_irma_quadrants",
    "od_x", "od_y", "od_radius_pct", "od_contrast", "fovea_x", "fovea_y", "od_fovea_dist_dd",
    "haem_count", "haem_q1", "haem_q2", "haem_q3", "haem_q4", "haem_q_min", "haem_q_max",
    "hard_exudate_count", "hard_exudate_area_pct", "exudate_fovea_min_dist_dd", "dme_flag", "cws_count", "cws_area_pct",
    "rule421_haem", "rule421_beading", "rule421_irma", "severe_npdr_flag", "ma_count", "ma_q1", "ma_q2", "ma_q3", "ma_q4",
)


def stage2_rows(features: DataFrame, kept: DataFrame, key: str, mask_area: float) -> DataFrame:
    """(key, the 45 columns of the second stage): the classifier-free row of an image and the counts of its kept candidates (key, lesion, cx, cy, area)."""
    rows = L.image_rows(features, kept, key, mask_area)
    missing, _ = L.schema_gaps(rows.columns, list(STAGE2_COLUMNS))
    if missing:
        raise ValueError(f"no columns {missing}")
    return rows.select(key, *(F.col(c) for c in STAGE2_COLUMNS))
