"""Filters of one image, numpy on two-dimensional arrays.

Borders: "mirror" repeats no edge pixel (``reflect`` in numpy), "symmetric" repeats it; extremes leave out what lies outside.
Correlations run over the frequency domain and are rounded to ``DIGITS`` decimals, so that pixels with equal
surroundings stay equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np

DIGITS = 9
_MODES = {"mirror": "reflect", "symmetric": "symmetric", "edge": "edge"}
#: Spectra of kernels are kept, a bounded number, for images of so few pixels; those of larger ones cost little beside the image's own.
KEPT_PIXELS = 1 << 15
LONGEST = 256
#: Weights of kernels that are taken pixel by pixel over images of ``KEPT_PIXELS``.
DIRECT = 50
#: Pixels times columns of images whose distances are found at once.
DIRECT_STEPS = 1 << 18
#: Pixels of a support from which on stretches of it are put together of shorter ones.
LONG_LINE = 9


def _small(image: np.ndarray) -> bool:
    """Whether sums along an axis are taken by a matrix, which has the square of its length."""
    return image.size <= KEPT_PIXELS and max(image.shape) <= LONGEST


def _fixed(array: np.ndarray) -> np.ndarray:
    """``array``, which many callers share from now on."""
    array.flags.writeable = False
    return array


@lru_cache(maxsize=512)
def _places(n: int, before: int, after: int, mode: str) -> np.ndarray:
    return _fixed(np.pad(np.arange(n), (before, after), mode=mode))


def bordered(image: np.ndarray, before: int, after: int, mode: str) -> np.ndarray:
    """``np.pad`` of both axes by a mode of ``numpy`` that takes pixels of the image."""
    return image.take(_places(image.shape[0], before, after, mode), 0).take(_places(image.shape[1], before, after, mode), 1)


@lru_cache(maxsize=32)
def _kept_spectra(weights: tuple[bytes, ...], sizes: tuple[tuple[int, int], ...], shape: tuple[int, int]) -> np.ndarray:
    return _fixed(np.stack([np.conj(np.fft.rfft2(np.frombuffer(x).reshape(size), shape)) for x, size in zip(weights, sizes)]))


def correlated(image: np.ndarray, kernels: Iterable[np.ndarray], mode: str = "mirror") -> Iterator[np.ndarray]:
    """For each odd-sized kernel the sum of kernel[dy, dx] times the pixel at (y + dy, x + dx); the image is transformed once for equal sizes."""
    h, w = image.shape
    kernels = list(kernels)
    if h * w <= KEPT_PIXELS and all(k.shape == kernels[0].shape and k.size <= DIRECT for k in kernels):
        # Small kernels of one size: all windows as one matrix.
        cy, cx = kernels[0].shape[0] // 2, kernels[0].shape[1] // 2
        ext = bordered(image.astype(np.float64), max(cy, cx), max(cy, cx), _MODES[mode])[max(cy, cx) - cy :, max(cy, cx) - cx :]
        windows = np.empty((kernels[0].size, h, w))
        for k in range(kernels[0].size):
            y, x = divmod(k, kernels[0].shape[1])
            windows[k] = ext[y : y + h, x : x + w]
        yield from np.round(np.stack([k.ravel() for k in kernels]) @ windows.reshape(len(windows), -1), DIGITS).reshape(-1, h, w)
        return
    if not kernels:
        return
    if (h + max(max(k.shape) for k in kernels)) * (w + max(max(k.shape) for k in kernels)) <= KEPT_PIXELS:
        # A small image is transformed once for all kernels, and goes back together.
        reach = max(max(k.shape) for k in kernels) // 2
        ext = bordered(image.astype(np.float64), reach, reach, _MODES[mode])
        spectra = _kept_spectra(tuple(k.astype(np.float64).tobytes() for k in kernels), tuple(k.shape for k in kernels), ext.shape)
        for back, kernel in zip(np.fft.irfft2(np.fft.rfft2(ext) * spectra, ext.shape), kernels):
            top, left = reach - kernel.shape[0] // 2, reach - kernel.shape[1] // 2
            yield np.round(back[top : top + h, left : left + w], DIGITS)
        return
    for reach, bank in groupby(kernels, lambda kernel: max(kernel.shape) // 2):
        ext = bordered(image.astype(np.float64), reach, reach, _MODES[mode])
        spectrum, shape = np.fft.rfft2(ext), ext.shape
        for kernel in bank:
            back = np.fft.irfft2(spectrum * np.conj(np.fft.rfft2(kernel, shape)), shape)
            top, left = reach - kernel.shape[0] // 2, reach - kernel.shape[1] // 2
            yield np.round(back[top : top + h, left : left + w], DIGITS)


def gaussian_profile(sigma: float, order: int, radius: int) -> np.ndarray:
    """A Gaussian of sum 1, or its first or second derivative, as weights of a correlation."""
    t = np.arange(-radius, radius + 1, dtype=np.float64)
    bell = np.exp(-0.5 * (t / sigma) ** 2)
    bell /= bell.sum()
    return (bell, bell * t / sigma**2, bell * (t**2 / sigma**4 - 1 / sigma**2))[order]


def gaussian(image: np.ndarray, sigma: float, radius: int | None = None, mode: str = "symmetric") -> np.ndarray:
    """Blur to four deviations unless a radius is given."""
    radius = int(4 * sigma + 0.5) if radius is None else radius
    if _small(image):
        down, right = (_along(n, float(sigma), radius, mode)[0] for n in image.shape)
        return np.round(down @ image.astype(np.float64) @ right.T, DIGITS)
    bell = gaussian_profile(sigma, 0, radius)
    return next(correlated(image, [np.outer(bell, bell)], mode))


def curvature(image: np.ndarray, sigmas: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Second derivatives (xx, yy, xy) of the blurred image at each scale, times the scale squared."""
    small = _small(image)
    for sigma in sigmas:
        radius = int(4 * sigma + 0.5)
        if small:
            down, right = (_along(n, float(sigma), radius) for n in image.shape)
            pixels = image.astype(np.float64)
            xx, yy, xy = (np.round(down[a] @ pixels @ right[b].T, DIGITS) for a, b in ((0, 2), (2, 0), (1, 1)))
        else:
            flat, first, second = (gaussian_profile(sigma, k, radius) for k in range(3))
            xx, yy, xy = correlated(image, [np.outer(flat, second), np.outer(second, flat), np.outer(first, first)], "symmetric")
        yield xx * sigma**2, yy * sigma**2, xy * sigma**2


@lru_cache(maxsize=64)
def _along(n: int, sigma: float, radius: int, mode: str = "symmetric") -> np.ndarray:
    """(order, n, n): what a Gaussian or a derivative of it makes of ``n`` pixels in a row, as sums of them; borders are among the sums."""
    taken = _places(n, radius, radius, _MODES[mode])
    out = np.zeros((3, n, n))
    for order in range(3):
        for k, weight in enumerate(gaussian_profile(sigma, order, radius).tolist()):
            np.add.at(out[order], (np.arange(n), taken[k : k + n]), weight)
    return _fixed(out)


@lru_cache(maxsize=64)
def _boxes(n: int, size: int, mode: str) -> np.ndarray:
    """(n, n): how often each of ``n`` pixels in a row is in the stretch of ``size`` about each of them."""
    taken = _places(n, size // 2, size - 1 - size // 2, _MODES[mode])
    out = np.zeros((n, n))
    for k in range(size):
        np.add.at(out, (np.arange(n), taken[k : k + n]), 1.0)
    return _fixed(out)


def percentile(values: np.ndarray, share: float) -> float:
    """``np.percentile`` of one share, by the two values about its place."""
    if not len(values):
        return float(np.percentile(values, share))
    place = (len(values) - 1) * (share / 100)
    low = min(math.floor(place), len(values) - 1)
    high = min(low + 1, len(values) - 1)
    about = np.partition(values, sorted({low, high, len(values) - 1}))
    a, b, rest = float(about[low]), float(about[high]), place - low
    if math.isnan(about[-1]):
        return math.nan
    return b - (b - a) * (1 - rest) if rest >= 0.5 else a + (b - a) * rest


def box_mean(image: np.ndarray, size: int, mode: str = "mirror") -> np.ndarray:
    """Mean of ``size`` x ``size`` pixels, from sums of sums; an even size reaches one further up and left."""
    before, after = size // 2, size - 1 - size // 2
    if _small(image):
        down, right = (_boxes(n, size, mode) for n in image.shape)
        return np.round(down @ image.astype(np.float64) @ right.T / size**2, DIGITS)
    ext = bordered(image.astype(np.float64), before, after, _MODES[mode])
    total = np.zeros((ext.shape[0] + 1, ext.shape[1] + 1))
    total[1:, 1:] = ext.cumsum(0).cumsum(1)
    out = total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]
    return np.round(out / size**2, DIGITS)


def sobel(image: np.ndarray, axis: int) -> np.ndarray:
    """Difference along ``axis`` of neighbours weighted 1, 2, 1 across."""
    smooth, step = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    return next(correlated(image, [np.outer(smooth, step) if axis == 1 else np.outer(step, smooth)], "symmetric"))


@lru_cache(maxsize=512)
def _kept_taps(support: bytes, size: tuple[int, int]) -> list[tuple[int, int]]:
    return [(y, x) for y, x in np.argwhere(np.frombuffer(support, dtype=bool).reshape(size)).tolist()]


@lru_cache(maxsize=512)
def _kept_spans(taps: tuple[tuple[int, int], ...], wide: int) -> tuple[list[tuple[int, int]], int, int]:
    """(size, place) of stretches of 1, 2, 4... taps along rows or columns that make up ``taps``, the step along them, the longest size."""
    best = None
    for axis, step in ((1, 1), (0, wide)):
        lines: dict[int, list[int]] = {}
        for tap in taps:
            lines.setdefault(tap[1 - axis], []).append(tap[axis])
        out = []
        for line, places in lines.items():
            places = sorted(places)
            begin = 0
            for k in range(1, len(places) + 1):
                if k == len(places) or places[k] != places[k - 1] + 1:
                    size = 1 << ((k - begin).bit_length() - 1)
                    for first in {places[begin], places[k - 1] + 1 - size}:
                        out.append((size, (line * wide + first) if axis == 1 else (first * wide + line)))
                    begin = k
        if best is None or len(out) < len(best[0]):
            best = out, step, max(size for size, _ in out)
    return best


def extreme(image: np.ndarray, support: np.ndarray, highest: bool) -> np.ndarray:
    """Largest or smallest value under a flat odd-sized support, which holds its own middle; masks and bytes stay what they are."""
    if support.all() and min(support.shape) > 1:
        return extreme(extreme(image, support[:1], highest), support[:, :1], highest)
    h, w = image.shape
    cy, cx = support.shape[0] // 2, support.shape[1] // 2
    taps = _kept_taps(np.asarray(support, dtype=bool).tobytes(), support.shape)
    if image.dtype in (bool, np.uint8):
        # Rows lie one behind the other, so a tap is one stretch of bytes.
        wide = w + 2 * cx
        ext = np.full((h + 2 * cy) * wide, 0 if highest else 1 if image.dtype == bool else 255, dtype=np.uint8)
        ext.reshape(-1, wide)[cy : cy + h, cx : cx + w] = image
        n = (h - 1) * wide + w
        held = np.empty(h * wide, dtype=np.uint8)
        pick, out = np.maximum if highest else np.minimum, held[:n]
        spans, size, step = {1: ext}, 1, 1
        if len(taps) >= LONG_LINE:
            taps, step, longest = _kept_spans(tuple(taps), wide)
            while 2 * size <= longest:
                # Of twice as many pixels behind each other, along rows or columns.
                held_ = spans[size]
                size *= 2
                spans[size] = held_.copy()
                pick(held_[: -(size // 2) * step], held_[(size // 2) * step :], out=spans[size][: -(size // 2) * step])
        else:
            taps = [(1, y * wide + x) for y, x in taps]
        for k, (size, at) in enumerate(taps):
            if k:
                pick(out, spans[size][at : at + n], out=out)
            else:
                out[:] = spans[size][at : at + n]
        return np.ascontiguousarray(held.reshape(h, wide)[:, :w]).view(image.dtype)
    fill = -np.inf if highest else np.inf
    ext = np.full((h + 2 * cy, w + 2 * cx), fill)
    ext[cy : cy + h, cx : cx + w] = image
    pick = np.maximum if highest else np.minimum
    out = np.full(image.shape, fill)
    for y, x in taps:
        pick(out, ext[y : y + h, x : x + w], out=out)
    return out


def closed(image: np.ndarray, support: np.ndarray) -> np.ndarray:
    """Largest values, then smallest ones, both under the support as it is."""
    return extreme(extreme(image, support, True), support, False)


@lru_cache(maxsize=64)
def ellipse(size: int) -> np.ndarray:
    """The filled disc of an odd size: each row reaches as far as the circle, to the nearest pixel."""
    r = size // 2
    dy = np.arange(size) - r
    reach = np.rint(r * np.sqrt(np.maximum(1 - (dy / max(r, 1)) ** 2, 0))).astype(int)
    return _fixed(np.abs(np.arange(size)[None] - r) <= reach[:, None])


@lru_cache(maxsize=64)
def _reaches(radius: int) -> np.ndarray:
    return _fixed(ellipse(2 * radius + 1).sum(1) // 2)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column after the last) of each unbroken run of a row's pixels, in row-major order."""
    h, w = mask.shape
    framed = np.zeros((h, w + 2), dtype=bool)
    framed[:, 1:-1] = mask
    y, x = np.nonzero(framed[:, 1:] != framed[:, :-1])
    return y[::2], x[::2], x[1::2]


def grown_runs(found: tuple[np.ndarray, np.ndarray, np.ndarray], h: int, w: int, radius: int) -> np.ndarray:
    """The mask of ``found`` (as ``runs`` gives them) grown by the disc of a radius: each run widens into all rows of the disc."""
    y, low, high = found
    reach = _reaches(radius)
    row = y[:, None] + np.arange(-radius, radius + 1)
    begin, end = np.maximum(low[:, None] - reach, 0), np.minimum(high[:, None] + reach, w)
    inside = (row >= 0) & (row < h)
    row = (row * (w + 1))[inside]
    step = np.bincount(row + begin[inside], minlength=h * (w + 1)) - np.bincount(row + end[inside], minlength=h * (w + 1))
    return step.reshape(h, w + 1).cumsum(1)[:, :w] > 0


def grown(mask: np.ndarray, radius: int) -> np.ndarray:
    """``mask`` grown by the disc of a radius: ``extreme`` under ``ellipse``, by runs of the disc's rows."""
    h, w = mask.shape
    found = runs(mask)
    if len(found[0]) * (2 * radius + 1) <= 8 * h * w:
        return grown_runs(found, h, w, radius)
    out = np.zeros((h, w), dtype=bool)
    total = np.pad(mask.cumsum(1), ((radius, radius), (1 + radius, radius)), mode="constant")
    total[:, 1 + radius + w :] = total[:, [radius + w]]
    for dy, reach in enumerate(_reaches(radius).tolist()):
        rows = total[dy : dy + h]
        out |= rows[:, radius + reach + 1 : radius + reach + 1 + w] > rows[:, radius - reach : radius - reach + w]
    return out


@lru_cache(maxsize=512)
def rotated_line(length: int, degrees: float) -> np.ndarray:
    """A line of ones through the middle of a square, turned counter-clockwise; bilinear at 32nds of a pixel, as image libraries do."""
    row = np.zeros((length + 2, length + 2))
    row[1 + length // 2, 1:-1] = 1.0
    centre, turn = length / 2 - 0.5, math.radians(degrees)
    y, x = np.mgrid[0:length, 0:length]
    cos, sin = math.cos(turn), math.sin(turn)
    # Each part is rounded to 1024ths by itself, then their sum to 32nds.
    steps = lambda part, rest: np.floor((np.rint(part * 1024) + np.rint(rest * 1024) + 16) / 32) / 32
    sx = steps(cos * x, centre - cos * centre + sin * centre - sin * y)
    sy = steps(sin * x, centre - sin * centre - cos * centre + cos * y)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    at = lambda a, b: row[np.clip(a + 1, 0, length + 1), np.clip(b + 1, 0, length + 1)]
    return _fixed((1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1)))


@lru_cache(maxsize=512)
def line_support(length: int, degrees: float) -> np.ndarray:
    return _fixed(rotated_line(length, degrees) >= 0.5)


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact distance of each pixel of ``mask`` to the nearest pixel outside it; infinite where there is none.

    Columns first, by the nearest rows above and below; rows then take the least of squares at growing steps, until no step can be shorter.
    """
    h, w = mask.shape
    y = np.arange(h, dtype=np.float64)[:, None]
    above = np.maximum.accumulate(np.where(mask, -np.inf, y), axis=0)
    below = np.minimum.accumulate(np.where(mask, np.inf, y)[::-1], axis=0)[::-1]
    up = np.minimum(y - above, below - y)
    square = up**2
    if square.size * w <= DIRECT_STEPS:
        # All steps of a small image at once; whole numbers of this size are exact in four bytes.
        away = (np.arange(w)[:, None] - np.arange(w)).astype(np.float32) ** 2
        return np.sqrt((square.astype(np.float32).T[:, :, None] + away[:, None, :]).min(0).astype(np.float64))
    best = square.copy()
    for step in range(1, w):
        if step * step >= best.max():
            break
        np.minimum(best[:, step:], square[:, :-step] + step * step, out=best[:, step:])
        np.minimum(best[:, :-step], square[:, step:] + step * step, out=best[:, :-step])
    return np.sqrt(best)


def stretched(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Linear interpolation to another size, corners on corners."""

    def places(n: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = np.arange(out) * ((n - 1) / max(out - 1, 1))
        low = np.minimum(t.astype(int), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), t - low

    y0, y1, fy = places(image.shape[0], height)
    x0, x1, fx = places(image.shape[1], width)
    rows = image[y0] * (1 - fy)[:, None] + image[y1] * fy[:, None]
    return rows[:, x0] * (1 - fx) + rows[:, x1] * fx


def shrinking(n: int, out: int) -> np.ndarray:
    """Weights (out, n) that give each of ``out`` pixels the mean of the stretch of ``n`` pixels it covers."""
    step = n / out
    begin, pixel = np.arange(out)[:, None] * step, np.arange(n)[None]
    return np.clip(np.minimum(begin + step, pixel + 1) - np.maximum(begin, pixel), 0, None) / step


def widening(n: int, out: int) -> np.ndarray:
    """Weights (out, n) of linear interpolation between pixels' middles; outer halves of border pixels stay level."""
    at = np.clip((np.arange(out) + 0.5) * n / out - 0.5, 0, n - 1)
    return np.clip(1 - np.abs(at[:, None] - np.arange(n)[None]), 0, None)


def median(image: np.ndarray, size: int) -> np.ndarray:
    """Median of ``size`` x ``size`` pixels, an odd size; the edge goes on beyond the border.  Row by row, so that memory is a row's windows."""
    ext = np.pad(image, size // 2, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(ext, (size, size))
    return np.stack([np.median(row.reshape(len(row), -1), axis=1) for row in windows])


def equalised(levels: np.ndarray, clip: float, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of whole levels 0..255, as image libraries do it.

    The image is mirrored to whole tiles.  Each tile's histogram is cut at ``clip`` times its mean; what is cut is dealt evenly over the levels, the
    rest one each at even steps.  Mappings are interpolated between the tiles' middles.
    """
    h, w = levels.shape
    more = (tiles - h % tiles, tiles - w % tiles) if h % tiles or w % tiles else (0, 0)
    whole = np.pad(levels.astype(np.int64), ((0, more[0]), (0, more[1])), mode="reflect")
    th, tw = whole.shape[0] // tiles, whole.shape[1] // tiles
    tile = np.arange(whole.shape[0])[:, None] // th * tiles + np.arange(whole.shape[1])[None] // tw
    counts = np.bincount((tile * 256 + whole).ravel(), minlength=tiles * tiles * 256).reshape(-1, 256)
    limit = max(int(clip * th * tw / 256), 1)
    excess = np.maximum(counts - limit, 0).sum(1)
    counts = np.minimum(counts, limit) + (excess // 256)[:, None]
    for k, rest in enumerate((excess % 256).tolist()):
        if rest:
            counts[k, : rest * max(256 // rest, 1) : max(256 // rest, 1)] += 1
    maps = np.clip(np.rint(counts.cumsum(1) * (255.0 / (th * tw))), 0, 255).reshape(tiles, tiles, 256)

    def between(n: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / side - 0.5
        low = np.floor(at).astype(int)
        return np.maximum(low, 0), np.minimum(low + 1, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between(h, th), between(w, tw)
    of = levels.astype(np.int64)
    row = lambda y: (1 - fx) * maps[y[:, None], x0[None], of] + fx * maps[y[:, None], x1[None], of]
    return np.clip(np.rint((1 - fy)[:, None] * row(y0) + fy[:, None] * row(y1)), 0, 255)
