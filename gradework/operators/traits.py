"""Sixteen traits of every lesion candidate: colour ratios, edge, shape, place and surroundings, in one kernel over an image's arrays.

Colours enter as ratios only, so that traits do not tell the camera.  Borders are not traced: the length of a region's outer
border is a sum over squares of 2 x 2 pixels once its holes are filled, and the points of the border carry half the steps
that meet in them, as often as a walk around the region would pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters as P
from . import landmarks as M
from . import lesion as L
from . import spots as S
from . import vessels as V
from .images import per_image
from .kernels import label

#: Traits in the order in which classifiers take them (fixed values).
FEATURES = (
    "b_over_g", "r_over_g", "saturation", "grad_mag_rim", "edge_sharpness", "boundary_smoothness", "area_px", "perimeter_px",
    "circularity", "eccentricity", "solidity", "dist_od_dd", "dist_fovea_dd", "dist_vessel_px", "local_contrast", "bg_ratio",
)
#: Reach of the ring that a candidate is held against, rays from its middle and pixels on each.
RING = (12, 24)
RAYS, RAY_PIXELS = 16, 15
LEAST_BORDER, LEAST_FITTED = 3, 5
#: Pixels of the box of regions whose shapes are kept, a bounded number, as small ones come again.
KEPT_REGION = 128
KEPT_SHAPES = 8192
#: Pixels of images in which candidates grow together.
TOGETHER = 1 << 18


class Shape(NamedTuple):
    perimeter: float
    hull_perimeter: float
    hull_area: float
    eccentricity: float


def filled(region: np.ndarray) -> np.ndarray:
    """``region`` with its holes: what the outside does not reach over sides."""
    if min(region.shape) < 3 or region.all():  # every pixel lies at the border of the box
        return region
    outside, _ = label(~np.pad(region, 1))
    return (outside != outside[0, 0])[1:-1, 1:-1]


def border(region: np.ndarray) -> tuple[float, np.ndarray]:
    """(length, steps that begin in each pixel) of the walk through the outer border pixels of a region without holes.

    Of a square of 2 x 2 pixels three pixels give a slanted step between the two beside the missing one, two on a side a
    straight one, two across a slanted one there and back (met once from each of them).
    """
    p = np.pad(region, 1).astype(np.int8)
    square = p[:-1, :-1] + 2 * p[:-1, 1:] + 4 * p[1:, 1:] + 8 * p[1:, :-1]
    straight, slanted, _ = _SQUARES
    number = np.bincount(square.ravel(), minlength=16)
    return int(number @ straight) + math.sqrt(2.0) * int(number @ slanted), _begun(square)[1:-1, 1:-1]


def _begun(square: np.ndarray) -> np.ndarray:
    """Steps that begin in each pixel, from the codes of the squares."""
    h, w = square.shape
    passed = np.zeros((h + 1, w + 1))
    for at, share in zip((passed[:h, :w], passed[:h, 1:], passed[1:, 1:], passed[1:, :w]), _SQUARES[2]):
        at += share[square]
    return passed


def _squares() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Straight steps, slanted ones, and steps that begin in each corner, of squares by the bits of their corners in a circle."""
    straight, slanted, begun = np.zeros(16, dtype=int), np.zeros(16, dtype=int), np.zeros((4, 16))
    for code in range(16):
        corners = [code >> k & 1 for k in range(4)]
        held = sum(corners)
        for k in range(4):
            here, after, across, before = (corners[(k + i) % 4] == 1 for i in range(4))
            side, corner, pair = held == 2 and here and after, held == 3 and after and before and not here, held == 2 and here and across
            straight[code] += side
            slanted[code] += corner + pair
            begun[k, code] += 0.5 * side + pair
            begun[(k + 1) % 4, code] += 0.5 * (side + corner)
            begun[(k + 3) % 4, code] += 0.5 * corner
    return straight, slanted, begun


_SQUARES = _squares()
#: Parts less holes, times four, that each square adds: one pixel adds 1, three take 1, two across take 2.
_PARTS_LESS_HOLES = np.array([{1: 1, 3: -1}.get(c.bit_count(), -2 if c in (5, 10) else 0) for c in range(16)])


def hull(region: np.ndarray) -> list[tuple[int, int]]:
    """Corners (x, y) of the convex hull of the pixels' middles, in a circle."""
    rows = np.nonzero(region.any(1))[0]
    left, right = region.argmax(1), region.shape[1] - 1 - region[:, ::-1].argmax(1)

    def chain(ends: np.ndarray, turn: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for y in rows.tolist():
            x = int(ends[y])
            while len(out) > 1 and turn * ((out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0])) >= 0:
                out.pop()
            out.append((x, y))
        return out

    one, other = chain(left, 1), chain(right, -1)
    return list(dict.fromkeys([*one, *other[::-1]]))


def eccentricity(weights: np.ndarray) -> float:
    """Of the ellipse fitted to weighted points by least squares: first a conic for its middle, then the axes about it.

    Points on a line or on two have no such ellipse; the axes are then those of their second moments.
    """
    y, x = np.nonzero(weights)
    n = weights[y, x]
    x, y = x - np.average(x, weights=n), y - np.average(y, weights=n)
    scale = max(float(np.abs(x).max()), float(np.abs(y).max()), 1.0)
    x, y, root = x / scale, y / scale, np.sqrt(n)

    def solved(columns: list[np.ndarray]) -> np.ndarray | None:
        matrix = np.stack(columns, axis=1) * root[:, None]
        found, _, rank, _ = np.linalg.lstsq(matrix, root, rcond=1e-9)
        return found if rank == len(columns) else None

    axes = None
    conic = solved([x * x, x * y, y * y, x, y])
    if conic is not None:
        a, b, c, d, e = conic
        turn = 4 * a * c - b * b
        if abs(turn) > 1e-12:
            u, v = x - (b * e - 2 * c * d) / turn, y - (b * d - 2 * a * e) / turn
            form = solved([u * u, u * v, v * v])
            if form is not None:
                # The axes' squares go with one over the form's own values.
                axes = np.linalg.eigvalsh([[form[0], form[1] / 2], [form[1] / 2, form[2]]])
    if axes is None:
        axes = np.linalg.eigvalsh(np.cov(np.stack([x, y]), aweights=n, bias=True))
    least, most = sorted(np.abs(axes).tolist())
    return math.sqrt(max(1.0 - least / most, 0.0)) if most > 0 else 0.0


def _eccentricities(of: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``eccentricity`` of ``n`` groups of points, in order of the group, and whether it is sure; each group is a row, filled up with points of no weight.

    What hangs on the last digits, as the place of a conic's middle that is nearly anywhere, is not sure.
    """
    number = np.bincount(of, minlength=n)
    cells = of, np.arange(len(of)) - (np.cumsum(number) - number)[of]
    a, b, w = np.zeros((3, n, int(number.max(initial=1))))
    a[cells], b[cells], w[cells] = x, y, weight
    total = w.sum(1, keepdims=True)
    held = w > 0
    a, b = (np.where(held, v - (v * w).sum(1, keepdims=True) / total, 0.0) for v in (a, b))
    scale = np.maximum(np.maximum(np.abs(a).max(1), np.abs(b).max(1)), 1.0)[:, None]
    a, b, root = a / scale, b / scale, np.sqrt(w)

    sure = np.ones(n, dtype=bool)

    def solved(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(the best factors of each row's columns for a sum of 1, whether they are the only ones)."""
        left, sizes, right = np.linalg.svd(np.stack(columns, axis=2) * root[:, :, None], full_matrices=False)
        whole = (sizes > 1e-9 * sizes[:, :1]).sum(1) == len(columns)
        least = sizes[:, -1] / np.maximum(sizes[:, 0], 1e-300)
        sure[(least > 1e-13) & (least < 1e-4)] = False
        sizes = np.where(whole[:, None], sizes, 1.0)
        return np.einsum("nki,nk->ni", right, np.einsum("npk,np->nk", left, root) / sizes), whole

    axes = np.stack([(w * p * q).sum(1) / total[:, 0] for p, q in ((a, a), (a, b), (a, b), (b, b))], axis=1).reshape(-1, 2, 2)
    if a.shape[1] >= 5:
        (c0, c1, c2, c3, c4), whole = (v.T if v.ndim == 2 else v for v in solved([a * a, a * b, b * b, a, b]))
        turn = 4 * c0 * c2 - c1 * c1
        sure[whole & (np.abs(turn) < 1e-5 * (c0 * c0 + c1 * c1 + c2 * c2))] = False
        whole &= np.abs(turn) > 1e-12
        turn = np.where(whole, turn, 1.0)
        a = a - np.where(whole, (c1 * c4 - 2 * c2 * c3) / turn, 0.0)[:, None]
        b = b - np.where(whole, (c1 * c3 - 2 * c0 * c4) / turn, 0.0)[:, None]
        form, only = solved([a * a, a * b, b * b])
        # The axes' squares go with one over the form's own values.
        fits = whole & only
        sure[whole & ~only] = False
        axes[fits] = np.stack([form[:, 0], form[:, 1] / 2, form[:, 1] / 2, form[:, 2]], axis=1).reshape(-1, 2, 2)[fits]
    else:
        fits = np.zeros(n, dtype=bool)
    values = np.sort(np.abs(np.linalg.eigvalsh(axes)), axis=1)
    sure[fits & (values[:, 0] < 1e-5 * values[:, 1])] = False
    sure[values[:, 0] > (1 - 1e-9) * values[:, 1]] = False  # the root of what is left of nearly equal axes
    return np.where(values[:, 1] > 0, np.sqrt(np.maximum(1 - values[:, 0] / np.where(values[:, 1] > 0, values[:, 1], 1.0), 0.0)), 0.0), sure


def shape(region: np.ndarray) -> Shape:
    """Border and hull of a region joined over sides or corners; borders of fewer than three steps have no length."""
    return shapes([region])[0]


#: Shapes of small regions by their pixels.
_KEPT: dict[tuple[bytes, tuple[int, int]], Shape] = {}


def shapes(regions: list[np.ndarray]) -> list[Shape]:
    """``shape`` of each region, measured together."""
    keys = [(r.tobytes(), r.shape) if r.size <= KEPT_REGION else None for r in regions]
    out = [_KEPT.get(k) if k else None for k in keys]
    todo = [k for k, known in enumerate(out) if known is None]
    if todo:
        for k, made in zip(todo, _shapes([regions[k] for k in todo])):
            out[k] = made
            if keys[k]:
                if len(_KEPT) >= KEPT_SHAPES:
                    _KEPT.clear()
                _KEPT[keys[k]] = made
    return out


def _canvas(regions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of squares of 2 x 2 pixels, the region of each row, first row of each region) of framed regions one below the other."""
    heights = np.array([len(r) + 2 for r in regions])
    first = np.cumsum(heights) - heights
    pixels = np.zeros((int(heights.sum()), max(r.shape[1] for r in regions) + 2), dtype=np.int8)
    for top, r in zip(first.tolist(), regions):
        pixels[top + 1 : top + 1 + len(r), 1 : 1 + r.shape[1]] = r
    square = pixels[:-1, :-1] + 2 * pixels[:-1, 1:] + 4 * pixels[1:, 1:] + 8 * pixels[1:, :-1]
    return square, np.repeat(np.arange(len(regions)), heights)[:-1], first


def _shapes(regions: list[np.ndarray]) -> list[Shape]:
    square, of, first = _canvas(regions)
    number = np.bincount((of[:, None] * 16 + square).ravel(), minlength=16 * len(regions)).reshape(-1, 16)
    # Squares tell the number of holes of pixels that are joined over sides or corners.
    holed = np.flatnonzero(number @ _PARTS_LESS_HOLES != 4).tolist()
    if holed:
        regions = list(regions)
        for k in holed:
            regions[k] = filled(regions[k])
        square, of, first = _canvas(regions)
        number = np.bincount((of[:, None] * 16 + square).ravel(), minlength=16 * len(regions)).reshape(-1, 16)
    straight, slanted, begun = _SQUARES
    lengths = (number @ straight + math.sqrt(2.0) * (number @ slanted)).tolist()
    passed = _begun(square)
    y, x = np.nonzero(passed)
    whose = np.append(of, len(regions) - 1)[y]
    steps = np.rint(np.bincount(whose, passed[y, x], len(regions))).astype(int)
    fitted = np.flatnonzero(steps >= LEAST_FITTED)
    round_ = np.zeros(len(regions))
    if len(fitted):
        chosen = np.zeros(len(regions), dtype=bool)
        chosen[fitted] = True
        here = chosen[whose]
        round_[fitted], sure = _eccentricities(np.searchsorted(fitted, whose[here]), x[here], y[here], passed[y, x][here], len(fitted))
        for k in fitted[~sure].tolist():
            round_[k] = eccentricity(passed[first[k] + 1 : first[k] + 1 + len(regions[k]), 1 : 1 + regions[k].shape[1]])
    out = []
    for region, length, n, e in zip(regions, lengths, steps.tolist(), round_.tolist()):
        corners = hull(region)
        turns = list(zip(corners, corners[1:] + corners[:1]))
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in turns)) / 2
        out.append(Shape(length, sum(math.dist(a, b) for a, b in turns), area, e) if n >= LEAST_BORDER else Shape(0.0, 0.0, area, 0.0))
    return out


def gradient_sizes(image: np.ndarray) -> np.ndarray:
    """Length of the gradient of neighbours weighted 1, 2, 1 across; no edge pixel is repeated."""
    e = np.pad(image, 1, mode="reflect" if min(image.shape) > 1 else "edge")
    across, down = e[:-2] + 2 * e[1:-1] + e[2:], e[:, :-2] + 2 * e[:, 1:-1] + e[:, 2:]
    return np.hypot(across[:, 2:] - across[:, :-2], down[2:] - down[:-2])


def edge_sharpness(image: np.ndarray, x: float, y: float) -> float:
    """Steepest change of the mean of the rays that leave a point; all rays are as long as the shortest that has two pixels in the image."""
    px, py = np.rint(x + _RAY_X).astype(int), np.rint(y + _RAY_Y).astype(int)
    h, w = image.shape
    n = RAY_PIXELS
    if px.min() < 0 or py.min() < 0 or px.max() >= w or py.max() >= h:
        inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
        reach = np.where(inside.all(1), RAY_PIXELS, inside.argmin(1))
        usable = reach >= 2
        if not usable.any():
            return 0.0
        n = int(reach[usable].min())
        px, py = px[usable, :n], py[usable, :n]
    mean = image.take(py * w + px).mean(0)
    return float(max(np.abs(mean[2:] - mean[:-2]).max(initial=0.0) / 2, abs(mean[1] - mean[0]), abs(mean[-1] - mean[-2])))


_TURNS = 2 * np.pi * np.arange(RAYS)[:, None] / RAYS
_RAY_X, _RAY_Y = np.arange(RAY_PIXELS)[None] * np.cos(_TURNS), np.arange(RAY_PIXELS)[None] * np.sin(_TURNS)


def regions(mask: np.ndarray, joined: int, least: float, most: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left, top, its pixels in the box around it) of each group of pixels of an allowed area, in the order of their first pixels."""
    labels, n = label(mask, joined)
    y, x = np.nonzero(labels)
    of = labels[y, x]
    area = np.bincount(of, minlength=n + 1)
    low, high = np.full((2, n + 1), max(mask.shape)), np.zeros((2, n + 1), dtype=int)
    for axis, place in enumerate((y, x)):
        np.minimum.at(low[axis], of, place)
        np.maximum.at(high[axis], of, place + 1)
    for k in range(1, n + 1):
        if least <= area[k] <= most:
            yield int(low[1, k]), int(low[0, k]), labels[low[0, k] : high[0, k], low[1, k] : high[1, k]] == k


class Picture(NamedTuple):
    """What candidates of an image are measured on."""

    colours: np.ndarray
    saturation: np.ndarray
    grey: np.ndarray
    gradient: np.ndarray
    vessel_distance: np.ndarray | None
    disc: tuple[float, float, float] | None
    fovea: tuple[float, float] | None


def picture(red: np.ndarray, green: np.ndarray, blue: np.ndarray, vessels: np.ndarray, disc: tuple[float, float, float] | None, fovea: tuple[float, float] | None) -> Picture:
    grey = np.rint(M.brightness(red, green, blue))
    away = P.distance(~vessels) if vessels.any() else None
    return Picture(np.stack([red, green, blue]), S.saturation(red, green, blue), grey, gradient_sizes(grey), away, disc, fovea)


def traits(p: Picture, evened: np.ndarray, left: int, top: int, region: np.ndarray) -> tuple[float, ...]:
    """``FEATURES`` of one candidate; what cannot be told (no vessel, disc or fovea, surroundings of 0) is 0."""
    return all_traits(p, [(evened, left, top, region)])[0]


def all_traits(p: Picture, candidates: list[tuple[np.ndarray, int, int, np.ndarray]]) -> list[tuple[float, ...]]:
    """``traits`` of an image's candidates (evened, left, top, region), measured together."""
    if not candidates:
        return []
    height, width = p.grey.shape
    places = [np.nonzero(region) for *_, region in candidates]
    area = np.array([len(y) for y, _ in places])
    begin, of = np.cumsum(area) - area, np.repeat(np.arange(len(area)), area)
    left, top = (np.array([c[k] for c in candidates]) for k in (1, 2))
    ys, xs = (np.concatenate([place[k] for place in places]) for k in (0, 1))
    cx, cy = left + np.add.reduceat(xs, begin) / area, top + np.add.reduceat(ys, begin) / area
    ys, xs = ys + top[of], xs + left[of]
    at = ys * width + xs
    red, green, blue, saturated = np.add.reduceat(np.concatenate([p.colours.reshape(3, -1).take(at, 1), p.saturation.take(at)[None]]), begin, axis=1) / area
    grounds = {id(c[0]): c[0] for c in candidates}
    ground, which = np.stack(list(grounds.values())).reshape(-1), {k: n for n, k in enumerate(grounds)}
    first = np.array([which[id(c[0])] for c in candidates]) * (height * width)
    level = np.add.reduceat(ground.take(first[of] + at), begin) / area

    # The rim: pixels that touch a region, by sides or corners, on a grid that is wider by a frame.
    wide, framed = width + 2, (height + 2) * (width + 2)
    own = of * framed + (ys + 1) * wide + xs + 1
    rim = np.setdiff1d((own[:, None] + np.array([-wide - 1, -wide, -wide + 1, -1, 1, wide - 1, wide, wide + 1])).ravel(), own)
    y, x = rim % framed // wide - 1, rim % wide - 1
    inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
    rim_of = rim[inside] // framed
    rim_gradient = np.bincount(rim_of, p.gradient.take((y * width + x)[inside]), len(area)) / np.maximum(np.bincount(rim_of, minlength=len(area)), 1)

    heights, widths = np.array([c[3].shape for c in candidates]).T
    boxes = np.stack([np.maximum(0, top - RING[1]), np.minimum(height, top + heights + RING[1]), np.maximum(0, left - RING[1]), np.minimum(width, left + widths + RING[1])])
    sharpness = _sharpness(p.grey, cx, cy, boxes)
    around = _around(p.grey.shape, ground, first, level, of, ys, xs, boxes)

    diameter = 2 * p.disc[2] if p.disc else 0.0
    of_region = shapes([c[3] for c in candidates])
    out = []
    for k, (r, g, b, sat, rim_, sharp, n, x, y, own_level, near) in enumerate(
        zip(*(v.tolist() for v in (red, green, blue, saturated, rim_gradient, sharpness, area, cx, cy, level, around)))
    ):
        s = of_region[k]
        smooth = s.hull_perimeter / s.perimeter if s.perimeter else 0.0
        circular = 4 * math.pi * n / s.perimeter**2 if s.perimeter else 0.0
        solid = n / s.hull_area if s.hull_area else 0.0
        to_disc = math.hypot(x - p.disc[0], y - p.disc[1]) / diameter if p.disc and diameter else 0.0
        to_fovea = math.hypot(x - p.fovea[0], y - p.fovea[1]) / diameter if p.fovea and diameter else 0.0
        to_vessel = float(p.vessel_distance[min(max(round(y), 0), height - 1), min(max(round(x), 0), width - 1)]) if p.vessel_distance is not None else 0.0
        row = (
            b / (g + 1e-6), r / (g + 1e-6), sat, rim_, sharp, smooth, float(n), s.perimeter,
            circular, s.eccentricity, solid, to_disc, to_fovea, to_vessel, own_level - near, own_level / near if near else 0.0,
        )
        out.append(tuple(v if math.isfinite(v) else 0.0 for v in row))
    return out


def _sharpness(grey: np.ndarray, cx: np.ndarray, cy: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """``edge_sharpness`` about each point within its box (first row, row after the last, first column, column after the last)."""
    y0, y1, x0, x1 = boxes
    # Places are rounded as seen from the box's corner.
    px, py = (np.rint((c - c0)[:, None, None] + ray).astype(int) for c, c0, ray in ((cx, x0, _RAY_X), (cy, y0, _RAY_Y)))
    whole = (px.min((1, 2)) >= 0) & (py.min((1, 2)) >= 0) & (px.max((1, 2)) < x1 - x0) & (py.max((1, 2)) < y1 - y0)
    out = np.empty(len(cx))
    if whole.any():
        mean = grey.take((py[whole] + y0[whole, None, None]) * grey.shape[1] + px[whole] + x0[whole, None, None]).mean(1)
        steps = np.concatenate([mean[:, 1:2] - mean[:, :1], (mean[:, 2:] - mean[:, :-2]) / 2, mean[:, -1:] - mean[:, -2:-1]], axis=1)
        out[whole] = np.abs(steps).max(1)
    for k in np.flatnonzero(~whole).tolist():
        out[k] = edge_sharpness(grey[y0[k] : y1[k], x0[k] : x1[k]], float(cx[k] - x0[k]), float(cy[k] - y0[k]))
    return out


def _around(size: tuple[int, int], ground: np.ndarray, first: np.ndarray, level: np.ndarray, of: np.ndarray, ys: np.ndarray, xs: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Mean of each candidate's ring on the ground that begins at its ``first``; its own level where no pixel lies in the ring.

    Candidates of small images grow together, one below the other with room between them; others in their boxes.
    """
    height, width = size
    new = np.ones(len(ys), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)
    at = np.flatnonzero(new)
    of, y, low = of[at], ys[at], xs[at]
    high = low + np.diff(at, append=len(new))
    ends = np.searchsorted(of, np.arange(len(first) + 1))
    out = level.copy()
    together = height * width <= P.KEPT_PIXELS
    step = max(1, TOGETHER // (height * width)) if together else 1
    for k in range(0, len(first), step):
        own = slice(ends[k], ends[min(k + step, len(first))])
        n = min(step, len(first) - k)
        y0, y1, x0, x1 = (0, height, 0, width) if together else boxes[:, k].tolist()
        room = y1 - y0 + RING[1]
        held = y[own] - y0 + (of[own] - k) * room, low[own] - x0, high[own] - x0
        ring = P.grown_runs(held, n * room, x1 - x0, RING[1]) & ~P.grown_runs(held, n * room, x1 - x0, RING[0])
        row, column = np.nonzero(ring.reshape(n, room, -1)[:, : y1 - y0].reshape(-1, x1 - x0))
        whose, row = np.divmod(row, y1 - y0)
        number = np.bincount(whose, minlength=n)
        total = np.bincount(whose, ground.take(first[k + whose] + (row + y0) * width + column + x0), n)
        some = number > 0
        out[k : k + n][some] = total[some] / number[some]
    return out


def candidate_rows(images: DataFrame, key: str, size: int, scale: V.Scale = V.Scale()) -> DataFrame:
    """(key, lesion, cand, cx, cy, area, ``FEATURES``, dme_touch), one row a candidate of ``spots.candidate_rows``, from the same columns.

    dme_touch tells of hard exudates whether they reach the macula, and is null for other lesions.  Nothing here is fitted.
    """
    marks = ["od_x", "od_y", "od_radius", "fovea_x", "fovea_y"]

    def kernel(red: np.ndarray, green: np.ndarray, blue: np.ndarray, _key: object, x: float, y: float, radius: float, fx: float, fy: float) -> list[tuple]:
        vessels = M.vessel_mask(green, V.round_view(size, scale.retina), scale)
        return found(red, green, blue, vessels, (x, y, radius), (fx, fy), scale)

    return _touching(per_image(images.dropna(subset=marks), ["red", "green", "blue"], [key, *marks], size, kernel, _MADE)).drop(*marks)


def located_candidate_rows(images: DataFrame, key: str, size: int, scale: V.Scale = V.Scale()) -> DataFrame:
    """``candidate_rows`` of images (key, red, green, blue), about the disc and the fovea that ``landmarks.image_features`` finds in them.

    Both are found in the kernel: images need not meet their landmarks by a join, which would shuffle pixels.
    """
    marks = ["od_x", "od_y", "od_radius", "fovea_x", "fovea_y"]

    def kernel(red: np.ndarray, green: np.ndarray, blue: np.ndarray, _key: object) -> list[tuple]:
        retina = V.round_view(size, scale.retina)
        vessels = M.vessel_mask(green, retina, scale)
        disc, fovea, _ = M.located(red, green, blue, vessels, retina, scale)
        at = disc.x, disc.y, disc.radius, fovea.x, fovea.y
        return [(*at, *row) for row in found(red, green, blue, vessels, at[:3], at[3:], scale)]

    made = ", ".join(f"{c} double" for c in marks) + ", " + _MADE
    return _touching(per_image(images, ["red", "green", "blue"], [key], size, kernel, made)).drop(*marks)


def features_and_candidates(images: DataFrame, key: str, size: int, scale: V.Scale = V.Scale()) -> DataFrame:
    """The rows of ``landmarks.image_features`` and of ``located_candidate_rows``, by one look at each image.

    A row of an image has null for lesion; its candidates have the image's landmarks and null for the vessel columns.
    """

    def kernel(red: np.ndarray, green: np.ndarray, blue: np.ndarray, _key: object) -> list[tuple]:
        marks, measured, mapped, at = M.features(red, green, blue, size, scale)
        rows = found(red, green, blue, M.vessels_of(mapped), at[:3], at[3:], scale)
        return [(*marks, *measured, *no_candidate), *((*marks, *no_vessels, *row) for row in rows)]

    no_candidate, no_vessels = (None,) * (5 + len(FEATURES)), (None,) * len(V.VESSEL_COLUMNS)
    return per_image(images, ["red", "green", "blue"], [key], size, kernel, f"{M.MADE}, {_MADE}")


def parted(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` of ``features_and_candidates`` as the two tables they stand for."""
    features = rows.filter(F.col("lesion").isNull()).select(key, *M.MARKS, *V.VESSEL_COLUMNS)
    candidates = rows.filter(F.col("lesion").isNotNull()).select(key, "lesion", "cand", "cx", "cy", "area", *FEATURES, "fovea_x", "fovea_y")
    return features, _touching(candidates).drop("fovea_x", "fovea_y")


_MADE = "lesion string, cand int, cx double, cy double, area double, " + ", ".join(f"{c} double" for c in FEATURES)


def _touching(rows: DataFrame) -> DataFrame:
    touch = L.macula_touch(F.col("cx"), F.col("cy"), F.col("area"), F.col("fovea_x"), F.col("fovea_y"))
    return rows.withColumn("dme_touch", F.when(F.col("lesion") == "hard_exudate", touch))


def found(
    red: np.ndarray, green: np.ndarray, blue: np.ndarray, vessels: np.ndarray, disc: tuple[float, float, float], fovea: tuple[float, float], scale: V.Scale
) -> list[tuple]:
    """(lesion, cand, cx, cy, area, ``FEATURES``) of an image's candidates."""
    size = len(green)
    retina, view = V.round_view(size, scale.retina), V.round_view(size, scale.measured)
    p = picture(red, green, blue, vessels, disc, fovea)
    rows, held = [], []
    for lesion, mask, joined, areas, evened in S.searches(red, green, blue, V.evened(green / 255.0, retina, scale), vessels, view, disc, fovea):
        for number, (left, top, region) in enumerate(regions(mask, joined, *areas), 1):
            ys, xs = np.nonzero(region)
            rows.append((lesion, number, left + float(xs.mean()), top + float(ys.mean()), float(len(ys))))
            held.append((evened, left, top, region))
    return [(*row, *measured) for row, measured in zip(rows, all_traits(p, held))]


def vector(features: tuple[str, ...] = FEATURES) -> Column:
    """The features as one array in their order; null, NaN and infinite ones are 0."""
    tidy = lambda c: F.when(F.abs(c) < F.lit(math.inf), c).otherwise(0.0)  # noqa: E731 - NaN sorts above infinity
    return F.array(*(tidy(F.col(f).cast("double")) for f in features))


def shape_rows(images: DataFrame, key: str, width: int, values: str, above: float, joined: int = 8) -> DataFrame:
    """(key, part, area, perimeter, hull_perimeter, hull_area, eccentricity) of each part of the mask of values above a threshold, in the order of first pixels."""

    def kernel(image: np.ndarray, _key: object) -> list[tuple]:
        parts = regions(image > above, joined, 1, math.inf)
        return [(n, int(region.sum()), *shape(region)) for n, (_, _, region) in enumerate(parts, 1)]

    return per_image(images, [values], [key], width, kernel, "part int, area long, perimeter double, hull_perimeter double, hull_area double, eccentricity double")
