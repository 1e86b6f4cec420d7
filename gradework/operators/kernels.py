"""Raster operators that windows cannot express, one image a group, numpy inside the task.

Spark deals the images out; a kernel sees one image's arrays and returns rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def dense(pdf: pd.DataFrame, value: str) -> tuple[np.ndarray, int, int]:
    """The image of a group's pixels and its first row and column; missing pixels are 0."""
    y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
    out = np.zeros((int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1), dtype=pdf[value].to_numpy().dtype)
    out[pdf["y"] - y0, pdf["x"] - x0] = pdf[value]
    return out, y0, x0


def label(mask: np.ndarray, connectivity: int = 4) -> tuple[np.ndarray, int]:
    """Component numbers from 1 in row-major order of their first pixels, 0 outside.

    Runs of a row's pixels are joined to those they touch in the next row; labels spread to the least of what is joined.
    """
    h, w = mask.shape
    begins = mask.copy()
    begins[:, 1:] &= ~mask[:, :-1]
    run = begins.ravel().cumsum().reshape(h, w)  # of each pixel, from 1
    touching = [(run[:-1], run[1:], mask[:-1] & mask[1:])]
    if connectivity == 8:
        touching += [(run[:-1, :-1], run[1:, 1:], mask[:-1, :-1] & mask[1:, 1:]), (run[:-1, 1:], run[1:, :-1], mask[:-1, 1:] & mask[1:, :-1])]
    upper, lower = (np.concatenate([side[both] for *sides, both in touching for side in (sides[k],)]) for k in (0, 1))
    root = np.arange(int(run[-1, -1]) + 1 if run.size else 1)
    while True:
        a, b = root[upper], root[lower]
        open_ = a != b
        if not open_.any():
            break
        upper, lower, a, b = upper[open_], lower[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    own = root == np.arange(len(root))
    own[0] = False
    number = own.cumsum()[root]
    return np.where(mask, number[run], 0), int(own.sum())


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur to four deviations, edges reflected."""
    radius = max(1, int(4 * sigma + 0.5))
    t = np.arange(-radius, radius + 1)
    kernel = np.exp(-0.5 * (t / sigma) ** 2)
    kernel /= kernel.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        width = [(0, 0), (0, 0)]
        width[axis] = (radius, radius)
        ext = np.pad(out, width, mode="symmetric")
        out = sum(k * np.take(ext, np.arange(i, i + out.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return out


def extreme(image: np.ndarray, offsets: list[tuple[int, int]], highest: bool) -> np.ndarray:
    """Largest or smallest value under a flat structuring element; outside does not count."""
    fill = -np.inf if highest else np.inf
    reach = max(max(abs(a), abs(b)) for a, b in offsets)
    ext = np.pad(image.astype(np.float64), reach, constant_values=fill)
    h, w = image.shape
    stack = [ext[reach + dy : reach + dy + h, reach + dx : reach + dx + w] for dy, dx in offsets]
    return np.maximum.reduce(stack) if highest else np.minimum.reduce(stack)


def closing(image: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return extreme(extreme(image, offsets, True), [(-a, -b) for a, b in offsets], False)


def line_offsets(length: int, angle: float) -> list[tuple[int, int]]:
    half = length // 2
    return sorted({(round(t * math.sin(angle)), round(t * math.cos(angle))) for t in range(-half, half + 1)})


def least_line_closing(image: np.ndarray, length: int, orientations: int = 12) -> np.ndarray:
    """Small dark spots are closed along every line; vessels stay open along their own."""
    return np.minimum.reduce([closing(image, line_offsets(length, math.pi * k / orientations)) for k in range(orientations)])


def vesselness(image: np.ndarray, sigmas: np.ndarray, beta: float = 0.5, gamma: float = 15.0) -> tuple[np.ndarray, np.ndarray]:
    """Frangi response for dark lines and the scale that gives it: second derivatives, normalised by sigma squared."""
    best, scale = np.full(image.shape, -1.0), np.zeros(image.shape)
    for sigma in sigmas:
        smooth = gaussian(image, float(sigma))
        gy, gx = np.gradient(smooth)
        (hyy, hyx), (_, hxx) = np.gradient(gy), np.gradient(gx)
        hyy, hyx, hxx = (sigma**2 * m for m in (hyy, hyx, hxx))
        root = np.sqrt(((hxx - hyy) / 2) ** 2 + hyx**2)
        centre = (hxx + hyy) / 2
        a, b = centre - root, centre + root
        small, large = np.where(np.abs(a) <= np.abs(b), a, b), np.where(np.abs(a) <= np.abs(b), b, a)
        blob = (small / np.where(large == 0, np.inf, large)) ** 2
        strength = small**2 + large**2
        response = np.where(large > 0, np.exp(-blob / (2 * beta**2)) * (1 - np.exp(-strength / (2 * gamma**2))), 0.0)
        better = response > best
        best, scale = np.where(better, response, best), np.where(better, sigma, scale)
    return best, scale


def equalised(image: np.ndarray, clip: float, tiles: int = 8, levels: int = 256) -> np.ndarray:
    """Contrast-limited equalisation of values 0..levels-1: clipped histograms of tiles, bilinear between their centres."""
    h, w = image.shape
    ty, tx = min(tiles, h), min(tiles, w)
    ys, xs = np.linspace(0, h, ty + 1).astype(int), np.linspace(0, w, tx + 1).astype(int)
    of = lambda ends, n: np.searchsorted(ends, np.arange(n), side="right") - 1
    tile = of(ys, h)[:, None] * tx + of(xs, w)[None]
    pixels = np.bincount(tile.ravel(), minlength=ty * tx)[:, None]
    hist = np.bincount((tile * levels + image.astype(int)).ravel(), minlength=ty * tx * levels).reshape(-1, levels).astype(np.float64)
    limit = np.maximum(1.0, clip * pixels / levels)
    excess = np.maximum(hist - limit, 0).sum(1, keepdims=True)
    maps = (np.cumsum(np.minimum(hist, limit) + excess / levels, axis=1) * (levels - 1) / np.maximum(1, pixels)).reshape(ty, tx, levels)
    fy = np.clip((np.arange(h) + 0.5) * ty / h - 0.5, 0, ty - 1)
    fx = np.clip((np.arange(w) + 0.5) * tx / w - 0.5, 0, tx - 1)
    y0, x0 = np.minimum(fy.astype(int), max(0, ty - 2)), np.minimum(fx.astype(int), max(0, tx - 2))
    y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None]
    v = image.astype(int)
    pick = lambda a, b: maps[a[:, None], b[None], v]
    return (1 - wy) * ((1 - wx) * pick(y0, x0) + wx * pick(y0, x1)) + wy * ((1 - wx) * pick(y1, x0) + wx * pick(y1, x1))


def resampled(image: np.ndarray, cy: float, cx: float, radius: float, target: float, size: int) -> np.ndarray:
    """``size`` square about the centre at ``target`` / ``radius`` scale, bilinear; outside is 0."""
    if radius <= 0:
        return np.zeros((size, size))
    step = radius / target
    y = cy + (np.arange(size) - (size - 1) / 2) * step
    x = cx + (np.arange(size) - (size - 1) / 2) * step
    ext = np.pad(image.astype(np.float64), 1)
    yi, xi = np.clip(y + 1, 0, ext.shape[0] - 1.001), np.clip(x + 1, 0, ext.shape[1] - 1.001)
    y0, x0 = yi.astype(int), xi.astype(int)
    wy, wx = (yi - y0)[:, None], (xi - x0)[None]
    at = lambda a, b: ext[a[:, None], b[None]]
    out = (1 - wy) * ((1 - wx) * at(y0, x0) + wx * at(y0, x0 + 1)) + wy * ((1 - wx) * at(y0 + 1, x0) + wx * at(y0 + 1, x0 + 1))
    inside = ((y >= -0.5) & (y <= image.shape[0] - 0.5))[:, None] & ((x >= -0.5) & (x <= image.shape[1] - 0.5))[None]
    return np.where(inside, out, 0.0)


def components(px: DataFrame, key: str, hit: str, connectivity: int = 4) -> DataFrame:
    """(key, y, x, component) of the pixels for which ``hit`` holds; component is y * 2^20 + x of its first pixel."""
    kind = dict(px.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, y0, x0 = dense(pdf, hit)
        labels, n = label(mask.astype(bool), connectivity)
        y, x = np.nonzero(labels)
        first = np.full(n + 1, 1 << 62, dtype=np.int64)
        np.minimum.at(first, labels[y, x], ((y + y0) << 20) + x + x0)
        return pd.DataFrame({key: pdf[key].iloc[0], "y": y + y0, "x": x + x0, "component": first[labels[y, x]]})

    return px.select(key, "y", "x", hit).groupBy(key).applyInPandas(run, f"{key} {kind}, y int, x int, component long")


def filled(px: DataFrame, key: str, hit: str) -> DataFrame:
    """(key, y, x, hit) with holes filled: what is not joined, by sides, to the border."""
    kind = dict(px.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, y0, x0 = dense(pdf, hit)
        mask = mask.astype(bool)
        labels, _ = label(~np.pad(mask, 1), 4)
        y, x = np.indices(mask.shape)
        return pd.DataFrame({key: pdf[key].iloc[0], "y": y.ravel() + y0, "x": x.ravel() + x0, "hit": (labels != labels[0, 0])[1:-1, 1:-1].ravel()})

    return px.select(key, "y", "x", hit).groupBy(key).applyInPandas(run, f"{key} {kind}, y int, x int, hit boolean")


def image_statistics(px: DataFrame, key: str, sigmas: tuple[float, ...] = (1.0, 1.5, 2.0)) -> DataFrame:
    """(key, vesselness, scale, closing_gap, contrast): means of the Frangi response, its scale, the gap of the
    least line closing, and the gain of equalisation, for images of values about 0."""
    kind = dict(px.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image, _, _ = dense(pdf, "v")
        v, s = vesselness(image * 255, np.array(sigmas))
        gap = least_line_closing(image, 5) - image
        span = image.max() - image.min()
        levels = np.rint((image - image.min()) / (span if span > 0 else 1) * 255)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "vesselness": [v.mean()], "scale": [s.mean()], "closing_gap": [gap.mean()], "contrast": [equalised(levels, 2.0, 2).std() / max(levels.std(), 1e-9)]})

    return px.select(key, "y", "x", "v").groupBy(key).applyInPandas(run, f"{key} {kind}, vesselness double, scale double, closing_gap double, contrast double")
