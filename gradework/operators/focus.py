"""Focus, light and colour of a view of known middle and radius: the older generation's measures, one row an image.

Measures of focus are taken on green of 0..1 inside the view, or on parts of it that hold little anatomy.  What cannot be told is null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from . import filters as P
from .images import per_image

#: Share of the radius that is measured, middle region, ring of patches, bins of the spectrum, window of contrast.
MEASURED, MIDDLE = 0.98, 0.40
PATCHES, RING, PATCH_SHARE = 8, 0.80, 0.025
SQUARE, LEAST_SQUARE, BINS, LEAST_BINS = 0.45, 64, (6, 120), 6
LEAST_REGION, WINDOW = 100, 15
SHRINK, LEAST_SHRUNK, GROUND_WINDOW = 16, 50, 0.4

FOCUS = ("varLap", "varLapNorm", "sml", "tenengrad", "tenengradVar", "brenner", "noiseSigma", "specSlope", "regionMin", "regionCV", *(f"region{k}" for k in range(1, 6)))
FIELD = ("bgMean", "bgCV", "bgSpread", "bgTiltMag", "bgTiltDir", "bgRadial", "localContrast", "localContrastP10")
COLUMNS = (*FOCUS, *FIELD, "colorSat")


def _away(shape: tuple[int, int], cy: float, cx: float) -> np.ndarray:
    return np.hypot((np.arange(shape[0]) - cy)[:, None], (np.arange(shape[1]) - cx)[None])


def _polar(shape: tuple[int, int], cy: float, cx: float) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[: shape[0], : shape[1]]
    return _away(shape, cy, cx), np.degrees(np.arctan2(cy - y, x - cx)) % 360


def sample(shape: tuple[int, int], cy: float, cx: float, radius: float, mode: str = "full") -> list[np.ndarray]:
    """Masks to measure on: the whole view ("full"), its middle ("central"), or eight round patches near its rim ("ring"), counter-clockwise from the right."""
    away = _away(shape, cy, cx)
    view = away <= MEASURED * radius
    if mode == "full":
        return [view]
    if mode == "central":
        return [view & (away < MIDDLE * radius)]
    if mode != "ring":
        raise ValueError(f"no sampling {mode!r}")
    turns = [2 * math.pi * k / PATCHES for k in range(PATCHES)]
    return [view & (_away(shape, cy - RING * radius * math.sin(t), cx + RING * radius * math.cos(t)) <= math.sqrt(PATCH_SHARE) * radius) for t in turns]


def spectral_slope(image: np.ndarray, cy: float, cx: float, radius: float) -> float | None:
    """Fall of log power by log radius of frequency in the square about the middle, under a Hann window; null of squares below 64 pixels."""
    half = int(SQUARE * radius)
    part = image[max(0, int(cy) - half) : int(cy) + half, max(0, int(cx) - half) : int(cx) + half]
    if min(part.shape) < LEAST_SQUARE:
        return None
    h, w = part.shape
    power = np.abs(np.fft.fft2((part - part.mean()) * np.hanning(h)[:, None] * np.hanning(w)[None])) ** 2
    # Radii count from half of each side, which lies between two frequencies if the side is odd.
    at = [np.rint(np.fft.fftfreq(n) * n) - (n % 2) / 2 for n in (h, w)]
    rings = np.hypot(at[0][:, None], at[1][None]).astype(int).ravel()
    mean = np.bincount(rings, power.ravel()) / np.maximum(np.bincount(rings), 1)
    low, high = BINS[0], min(BINS[1], len(mean))
    if high < low + LEAST_BINS:
        return None
    x, y = np.log(np.arange(low, high)), np.log(mean[low:high] + 1e-20)
    return float(-((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())


def focus(image: np.ndarray, mask: np.ndarray, cy: float, cx: float, radius: float) -> dict[str, float | None]:
    """``FOCUS`` of the mask's pixels; neighbours two apart and those of the modified Laplacian wrap around the image's border."""
    if not mask.any():
        return dict.fromkeys(FOCUS)
    e = np.pad(image, 1, mode="symmetric")
    up, down, left, right = e[:-2, 1:-1], e[2:, 1:-1], e[1:-1, :-2], e[1:-1, 2:]
    laplacian = up + down + left + right - 4 * image
    gx, gy = P.sobel(image, 1), P.sobel(image, 0)
    turned = sum(np.abs(2 * image - np.roll(image, 1, axis) - np.roll(image, -1, axis)) for axis in (0, 1))
    noise = e[:-2, :-2] + e[:-2, 2:] + e[2:, :-2] + e[2:, 2:] - 2 * (up + down + left + right) + 4 * image
    away, angle = _polar(image.shape, cy, cx)
    normed = lambda m: float(laplacian[m].var() / max(image[m].var(), 1e-12))
    outer = mask & (away >= MIDDLE * radius)
    parts = [mask & (away < MIDDLE * radius), *(outer & (angle >= 90 * k) & (angle < 90 * (k + 1)) for k in range(4))]
    regions = [normed(p) if p.sum() > LEAST_REGION else None for p in parts]
    known = [v for v in regions if v is not None]
    return {
        "varLap": float(laplacian[mask].var()),
        "varLapNorm": normed(mask),
        "sml": float(turned[mask].mean()),
        "tenengrad": float((gx**2 + gy**2)[mask].mean()),
        "tenengradVar": float(np.hypot(gx, gy)[mask].var()),
        "brenner": float(((np.roll(image, -2, 1) - image) ** 2)[mask].mean()),
        "noiseSigma": math.sqrt(math.pi / 2) * float(np.abs(noise)[mask].mean()) / 6,
        "specSlope": spectral_slope(image, cy, cx, radius),
        "regionMin": min(known, default=None),
        "regionCV": float(np.std(known) / np.mean(known)) if known and np.mean(known) else None,
        **{f"region{k}": v for k, v in enumerate(regions, 1)},
    }


def field(image: np.ndarray, view: np.ndarray, radius: float) -> dict[str, float | None]:
    """``FIELD``: level, spread, tilt and radial slope of the background (a sixteenth of the image, median in wide windows), and local contrast."""
    size = [max(1, round(n / SHRINK)) for n in image.shape]
    small, inside = P.stretched(image, *size), P.stretched(view.astype(np.float64), *size) > 0.5
    if inside.sum() < LEAST_SHRUNK:
        inside = np.ones(small.shape, dtype=bool)
    # The surround is held at the inner median: black would make a fall of light at the rim.
    ground = P.median(np.where(inside, small, np.median(small[inside])), max(5, 2 * round(0.5 * GROUND_WINDOW * radius / SHRINK) + 1))[inside]
    y, x = np.nonzero(inside)
    v, u = (y - size[0] / 2) * SHRINK / radius, (x - size[1] / 2) * SHRINK / radius
    ones = np.ones(len(u))
    (a, b, _), (slope, _) = (np.linalg.lstsq(np.stack(c, axis=1), ground, rcond=None)[0] for c in ([u, v, ones], [np.hypot(u, v), ones]))
    low, high = np.percentile(ground, [5, 95])
    mean = P.box_mean(image, WINDOW, "symmetric")
    contrast = np.sqrt(np.maximum(P.box_mean(image**2, WINDOW, "symmetric") - mean**2, 0))[view]
    return {
        "bgMean": float(ground.mean()),
        "bgCV": float(ground.std() / max(ground.mean(), 1e-9)),
        "bgSpread": float(high - low),
        "bgTiltMag": math.hypot(a, b),
        "bgTiltDir": math.degrees(math.atan2(b, a)),
        "bgRadial": float(slope),
        "localContrast": float(contrast.mean()) if len(contrast) else None,
        "localContrastP10": float(np.percentile(contrast, 10)) if len(contrast) else None,
    }


def colour_saturation(red: np.ndarray, green: np.ndarray, blue: np.ndarray, mask: np.ndarray) -> float | None:
    """Mean spread of the colours over the largest, of the original image: a resampled one has lost its clipped levels."""
    if not mask.any():
        return None
    most, least = np.maximum(np.maximum(red, green), blue)[mask], np.minimum(np.minimum(red, green), blue)[mask]
    return float(((most - least) / np.maximum(most, 1e-9)).mean())


def focus_rows(images: DataFrame, key: str, width: int, mode: str = "full") -> DataFrame:
    """(key, ``COLUMNS``), one row an image of (key, red, green, blue, cy, cx, radius), levels 0..255; focus is measured on the pixels of ``sample``.

    Images without pixels make no row, nor do those whose view has no middle or radius.
    """
    marks = ["cy", "cx", "radius"]

    def kernel(red: np.ndarray, green: np.ndarray, blue: np.ndarray, _key: object, cy: float, cx: float, radius: float) -> list[tuple]:
        if not radius > 0:
            return []
        level = green / 255.0
        view = sample(green.shape, cy, cx, radius)[0]
        out = focus(level, np.logical_or.reduce(sample(green.shape, cy, cx, radius, mode)), cy, cx, radius) | field(level, view, radius)
        out["colorSat"] = colour_saturation(red, green, blue, view)
        return [tuple(out[c] for c in COLUMNS)]

    return per_image(images.dropna(subset=marks), ["red", "green", "blue"], [key, *marks], width, kernel, ", ".join(f"{c} double" for c in COLUMNS)).drop(*marks)
