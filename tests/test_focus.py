"""Older measures of focus, light and colour against loops and known figures."""

import math

import numpy as np
import pytest

from gradework.operators import filters as P
from gradework.operators import focus as O
from gradework.plans import vision


def made(size=(40, 44), seed=2):
    return np.random.default_rng(seed).random(size)


def test_focus_against_loops():
    image = made()
    h, w = image.shape
    cy, cx, radius = 20.0, 22.0, 18.0
    mask = O.sample(image.shape, cy, cx, radius)[0]
    places = [(y, x) for y in range(h) for x in range(w) if math.hypot(y - cy, x - cx) <= 0.98 * radius]
    assert int(mask.sum()) == len(places)
    at = lambda y, x: image[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    lap = {q: at(q[0] + 1, q[1]) + at(q[0] - 1, q[1]) + at(q[0], q[1] + 1) + at(q[0], q[1] - 1) - 4 * at(*q) for q in places}
    gx = {(y, x): sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1))) for y, x in places}
    gy = {(y, x): sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1))) for y, x in places}
    got = O.focus(image, mask, cy, cx, radius)
    values = list(lap.values())
    assert got["varLap"] == pytest.approx(np.var(values))
    assert got["varLapNorm"] == pytest.approx(np.var(values) / np.var([image[q] for q in places]))
    assert got["tenengrad"] == pytest.approx(np.mean([gx[q] ** 2 + gy[q] ** 2 for q in places]))
    assert got["tenengradVar"] == pytest.approx(np.var([math.hypot(gx[q], gy[q]) for q in places]))
    assert got["sml"] == pytest.approx(np.mean([abs(2 * image[y, x] - image[y, x - 1] - image[y, x + 1]) + abs(2 * image[y, x] - image[y - 1, x] - image[y + 1, x]) for y, x in places]))
    assert got["brenner"] == pytest.approx(np.mean([(image[y, (x + 2) % w] - image[y, x]) ** 2 for y, x in places]))
    noise = [sum(((1, -2, 1), (-2, 4, -2), (1, -2, 1))[a + 1][b + 1] * at(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) for y, x in places]
    assert got["noiseSigma"] == pytest.approx(math.sqrt(math.pi / 2) * np.mean(np.abs(noise)) / 6)
    regions = [[q for q in places if math.hypot(q[0] - cy, q[1] - cx) < 0.4 * radius]]
    for k in range(4):
        regions.append([q for q in places if math.hypot(q[0] - cy, q[1] - cx) >= 0.4 * radius and 90 * k <= math.degrees(math.atan2(cy - q[0], q[1] - cx)) % 360 < 90 * (k + 1)])
    expected = [np.var([lap[q] for q in r]) / np.var([image[q] for q in r]) if len(r) > 100 else None for r in regions]
    assert [got[f"region{k}"] for k in range(1, 6)] == pytest.approx(expected)
    assert got["regionMin"] == pytest.approx(min(expected)) and got["regionCV"] == pytest.approx(np.std(expected) / np.mean(expected))
    assert got["specSlope"] is None  # its square has 16 pixels
    small = O.focus(image, O.sample(image.shape, cy, cx, 5.0)[0], cy, cx, 5.0)
    assert small["regionMin"] is None and small["regionCV"] is None and small["varLap"] > 0
    assert set(O.focus(image, np.zeros_like(mask), cy, cx, radius).values()) == {None}


def test_noise_of_known_size_is_found():
    image = 0.5 + np.random.default_rng(3).normal(0, 0.02, (200, 200))
    assert O.focus(image, np.ones(image.shape, dtype=bool), 100, 100, 100)["noiseSigma"] == pytest.approx(0.02, rel=0.05)


@pytest.mark.parametrize("size", [(70, 70), (65, 71)])
def test_spectra_against_a_shifted_transform(size):
    image = made((100, 110))
    cy, cx = 40.0, 50.0
    part = image[:size[0], :size[1]]
    radius = 200.0  # the square reaches past the image on all sides
    h, w = part.shape
    held = (part - part.mean()) * np.outer(np.hanning(h), np.hanning(w))
    power = np.abs(np.fft.fftshift(np.fft.fft2(held))) ** 2
    rings = np.hypot(np.arange(h)[:, None] - h / 2, np.arange(w)[None] - w / 2).astype(int)
    last = rings.max()
    r = np.arange(6, min(120, last + 1))
    slope = -np.polyfit(np.log(r), np.log([power[rings == k].mean() if (rings == k).any() else 1e-20 for k in r]), 1)[0]
    assert O.spectral_slope(part, cy, cx, radius) == pytest.approx(slope)
    assert O.spectral_slope(image[:63], cy, cx, radius) is None
    assert O.spectral_slope(P.gaussian(image, 2.0), cy, cx, radius) > O.spectral_slope(image, cy, cx, radius) + 1


def test_samples():
    full, central, ring = (O.sample((100, 100), 50, 50, 45, m) for m in ("full", "central", "ring"))
    assert len(ring) == 8 and (central[0] & ~full[0]).sum() == 0
    middles = [np.mean(np.nonzero(p), axis=1) for p in ring]
    assert middles[0] == pytest.approx([50, 86], abs=1) and middles[2] == pytest.approx([14, 50], abs=1)
    assert all((p & ~full[0]).sum() == 0 and p.sum() == pytest.approx(math.pi * 0.025 * 45**2, rel=0.15) for p in ring)
    assert not (np.logical_or.reduce(ring) & central[0]).any()
    with pytest.raises(ValueError):
        O.sample((4, 4), 2, 2, 2, "elsewhere")


def test_tilt_and_fall_of_light():
    y, x = np.mgrid[:320, :320].astype(float)
    view = O.sample((320, 320), 160, 160, 150)[0]
    tilted = O.field(np.where(view, 0.5 + 0.1 * (x - 160) / 150, 0), view, 150.0)
    assert abs(tilted["bgTiltDir"]) < 5 and tilted["bgTiltMag"] > 2 * abs(tilted["bgRadial"]) and tilted["bgTiltMag"] > 0.04
    fallen = O.field(np.where(view, 0.8 - 0.3 * np.hypot(y - 160, x - 160) / 150, 0), view, 150.0)
    assert fallen["bgRadial"] < -0.1 and fallen["bgTiltMag"] < 0.02
    level = O.field(np.full((320, 320), 0.4), view, 150.0)
    assert (level["bgMean"], level["bgCV"], level["bgSpread"], level["localContrast"]) == pytest.approx((0.4, 0, 0, 0), abs=1e-4)
    stripes = O.field(np.where(x // 20 % 2 == 0, 0.3, 0.6), view, 150.0)
    assert stripes["localContrast"] > stripes["localContrastP10"] >= 0


def test_colour_saturation():
    red, green, blue = np.array([[200.0, 0, 10]]), np.array([[100.0, 0, 10]]), np.array([[50.0, 0, 10]])
    assert O.colour_saturation(red, green, blue, np.array([[True, True, True]])) == pytest.approx(0.25)
    assert O.colour_saturation(red, green, blue, np.array([[False] * 3])) is None


def test_rows(spark, sf_dir):
    photos = vision.placed(spark, sf_dir).filter("vec_id < 8")
    odd = photos.limit(1).selectExpr("-1L as vec_id", "red", "green", "blue", "cy", "cx", "0D as radius").unionByName(photos.limit(1).selectExpr("-2L as vec_id", "red", "array() as green", "blue", "cy", "cx", "radius"))
    for mode in ("full", "central", "ring"):
        rows = O.focus_rows(photos.unionByName(odd), "vec_id", vision.WIDTH, mode)
        assert rows.columns == ["vec_id", *O.COLUMNS]
        assert sorted(r["vec_id"] for r in rows.collect()) == list(range(8))
