"""Traits of lesion candidates against walks, loops and figures with known measures."""

import math

import numpy as np
import pytest

from gradework.operators import filters as P
from gradework.operators import spots as S
from gradework.operators import traits as T
from gradework.plans import vision

AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
ALL = (1, math.inf)


def walk(region):
    """(length, pixels passed) of a walk around a region that keeps the outside on its left hand."""
    m = np.pad(region, 1)
    at, look, first, length, passed = tuple(np.argwhere(m)[0]), 6, None, 0.0, np.zeros(region.shape)
    while True:
        ways = [(look + k) % 8 for k in range(8)]
        way = next((q for q in ways if m[at[0] + AROUND[q][0], at[1] + AROUND[q][1]]), None)
        if way is None or (at, way) == first:
            return length, passed
        first = first or (at, way)
        length += math.sqrt(2) if way % 2 else 1
        passed[at[0] - 1, at[1] - 1] += 1
        at, look = (at[0] + AROUND[way][0], at[1] + AROUND[way][1]), (way + (5 if way % 2 else 6)) % 8


@pytest.mark.parametrize("joined", [4, 8])
def test_borders_against_walks(joined):
    rng = np.random.default_rng(3)
    for _ in range(150):
        mask = rng.random((rng.integers(1, 10), rng.integers(1, 10))) < 0.6
        for _, _, region in T.regions(mask, joined, *ALL):
            length, passed = T.border(T.filled(region))
            expected, steps = walk(region)
            assert length == pytest.approx(expected)
            assert (passed == steps).all()


def test_hulls_against_all_pairs_of_pixels():
    rng = np.random.default_rng(4)
    for _ in range(60):
        region = next(T.regions(rng.random((8, 8)) < 0.7, 8, 10, math.inf))[2]
        points = [(int(x), int(y)) for y, x in np.argwhere(region)]
        # An edge of the hull has all points on one side of it.
        edges = {(a, b) for a in points for b in points if a != b and all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) >= 0 for c in points)}
        area = sum(math.dist(a, b) for a, b in edges)  # edges through several pixels are listed in parts and as a whole
        corners = T.hull(region)
        turns = list(zip(corners, corners[1:] + corners[:1]))
        assert all((a, b) in edges or (b, a) in edges for a, b in turns)
        assert sum(math.dist(a, b) for a, b in turns) <= area + 1e-9


def test_shapes_with_known_measures():
    assert T.shape(np.ones((4, 7), dtype=bool))[:3] == (18.0, 18.0, 18.0)
    assert T.shape(np.ones((1, 5), dtype=bool)) == (8.0, 8.0, 0.0, 1.0)
    assert T.shape(np.ones((1, 1), dtype=bool)) == T.shape(np.eye(2, dtype=bool)) == (0.0, 0.0, 0.0, 0.0)
    ring = np.ones((9, 9), dtype=bool)
    ring[2:7, 2:7] = False
    assert T.shape(ring) == T.shape(np.ones((9, 9), dtype=bool))
    y, x = np.mgrid[-40:41, -40:41]
    assert T.shape(x * x + y * y <= 900).eccentricity < 0.02
    for turn in (0.0, 0.5, 1.2):
        u, v = math.cos(turn) * x + math.sin(turn) * y, math.cos(turn) * y - math.sin(turn) * x
        oval = T.shape((u / 36) ** 2 + (v / 12) ** 2 <= 1)
        assert oval.eccentricity == pytest.approx(math.sqrt(1 - 1 / 9), abs=0.006)
        assert oval.hull_area == pytest.approx(math.pi * 36 * 12, rel=0.06)


def test_fit_passes_through_points_of_an_ellipse():
    # Twelve points of an ellipse with half axes 25 and 15, all on whole pixels: eccentricity 0.8.
    weights = np.zeros((51, 51))
    for a, b in ((25, 0), (20, 9), (15, 12), (7, 14.4)):
        if float(b).is_integer():
            for i in (-1, 1):
                for j in (-1, 1):
                    weights[25 + j * int(b), 25 + i * a] = 1
    weights[[10, 40], 25] = 1
    assert T.eccentricity(weights) == pytest.approx(0.8, abs=1e-9)
    assert T.eccentricity(5 * weights) == pytest.approx(0.8, abs=1e-9)


def test_discs_grow_by_their_rows():
    mask = np.random.default_rng(5).random((30, 41)) < 0.02
    for radius in (1, 2, 5, 12, 24):
        assert (P.grown(mask, radius) == P.extreme(mask, P.ellipse(2 * radius + 1), True)).all()
    assert not P.grown(np.zeros((3, 3), dtype=bool), 2).any()


def test_edge_sharpness_against_loops():
    image = np.random.default_rng(6).integers(0, 255, (30, 34)).astype(float)
    for x, y in ((15.0, 14.5), (1.0, 28.0), (0.0, 0.0), (33.0, 3.2)):
        rays = []
        for k in range(16):
            ray = []
            for r in range(15):
                px, py = round(x + r * math.cos(2 * math.pi * k / 16)), round(y + r * math.sin(2 * math.pi * k / 16))
                if not (0 <= px < 34 and 0 <= py < 30):
                    break
                ray.append(image[py, px])
            if len(ray) > 1:
                rays.append(ray)
        n = min(map(len, rays))
        mean = [sum(ray[i] for ray in rays) / len(rays) for i in range(n)]
        steps = [mean[1] - mean[0], *((mean[i + 1] - mean[i - 1]) / 2 for i in range(1, n - 1)), mean[-1] - mean[-2]]
        assert T.edge_sharpness(image, x, y) == pytest.approx(max(map(abs, steps)))
    assert T.edge_sharpness(np.ones((1, 1)), 0.0, 0.0) == 0.0
    step = np.where(np.hypot(*np.mgrid[-20:21, -20:21]) < 7, 200.0, 100.0)
    assert T.edge_sharpness(step, 20.0, 20.0) > 2 * T.edge_sharpness(P.gaussian(step, 3.0), 20.0, 20.0)


def made(seed=7, size=60):
    rng = np.random.default_rng(seed)
    red, green, blue = (rng.integers(20, 255, (size, size)).astype(float) for _ in range(3))
    vessels = np.zeros((size, size), dtype=bool)
    vessels[:, min(31, size - 1)] = True
    return red, green, blue, vessels


def test_traits_against_loops():
    red, green, blue, vessels = made()
    evened = green + 3.0
    mask = np.zeros(green.shape, dtype=bool)
    mask[20:26, 10:15] = mask[23, 15:19] = mask[0:3, 57:60] = True
    mask[22:24, 12] = False
    disc, fovea = (40.0, 30.0, 6.0), (12.0, 50.0)
    p = T.picture(red, green, blue, vessels, disc, fovea)
    found = list(T.regions(mask, 8, *ALL))
    assert [(left, top, region.shape) for left, top, region in found] == [(57, 0, (3, 3)), (10, 20, (6, 9))]
    for left, top, region in found:
        own = [(top + y, left + x) for y, x in np.argwhere(region)]
        inside = set(own)
        got = dict(zip(T.FEATURES, T.traits(p, evened, left, top, region)))
        mean = lambda image: sum(image[q] for q in own) / len(own)
        assert got["b_over_g"] == pytest.approx(mean(blue) / mean(green), rel=1e-6)
        assert got["r_over_g"] == pytest.approx(mean(red) / mean(green), rel=1e-6)
        most, least = np.max([red, green, blue], 0), np.min([red, green, blue], 0)
        assert got["saturation"] == pytest.approx(mean((most - least) / most), abs=0.002)
        at = lambda y, x: p.grey[abs(y) if y < 60 else 118 - y, abs(x) if x < 60 else 118 - x]

        def slope(y, x):
            dx = sum(w * (at(y + k, x + 1) - at(y + k, x - 1)) for k, w in ((-1, 1), (0, 2), (1, 1)))
            dy = sum(w * (at(y + 1, x + k) - at(y - 1, x + k)) for k, w in ((-1, 1), (0, 2), (1, 1)))
            return math.hypot(dx, dy)

        rim = {(y + a, x + b) for y, x in own for a in (-1, 0, 1) for b in (-1, 0, 1)} - inside
        rim = [q for q in rim if 0 <= q[0] < 60 and 0 <= q[1] < 60]
        assert got["grad_mag_rim"] == pytest.approx(sum(slope(*q) for q in rim) / len(rim))
        s = T.shape(region)
        assert (got["area_px"], got["perimeter_px"]) == (len(own), s.perimeter)
        assert got["circularity"] == pytest.approx(4 * math.pi * len(own) / s.perimeter**2)
        assert (got["solidity"], got["boundary_smoothness"]) == pytest.approx((len(own) / s.hull_area, s.hull_perimeter / s.perimeter))
        cy, cx = np.mean(own, axis=0)
        assert got["dist_od_dd"] == pytest.approx(math.hypot(cx - 40, cy - 30) / 12)
        assert got["dist_fovea_dd"] == pytest.approx(math.hypot(cx - 12, cy - 50) / 12)
        assert got["dist_vessel_px"] == pytest.approx(abs(round(cx) - 31))
        whole = np.zeros(green.shape, dtype=bool)
        whole[tuple(np.transpose(own))] = True
        near, far = (P.extreme(whole, P.ellipse(2 * r + 1), True) for r in (12, 24))
        around = evened[far & ~near].mean()
        assert got["local_contrast"] == pytest.approx(mean(evened) - around)
        assert got["bg_ratio"] == pytest.approx(mean(evened) / around)


def test_what_cannot_be_told_is_zero():
    red, green, blue, vessels = made(size=10)
    p = T.picture(red, green, blue, np.zeros_like(vessels), None, None)
    got = dict(zip(T.FEATURES, T.traits(p, np.zeros_like(green), 0, 0, np.ones((10, 10), dtype=bool))))
    assert all(got[f] == 0.0 for f in ("dist_od_dd", "dist_fovea_dd", "dist_vessel_px", "local_contrast", "bg_ratio", "grad_mag_rim"))
    assert got["area_px"] == 100.0


def test_vectors_are_tidied(spark):
    rows = spark.sql("select 1D as a, double('nan') as b, double('inf') as c, cast(null as double) as d, -2D as e")
    assert rows.select(T.vector(("a", "b", "c", "d", "e")).alias("v")).first()["v"] == [1.0, 0.0, 0.0, 0.0, -2.0]


def test_rows_are_those_of_the_candidates(spark, sf_dir):
    eyes = vision.eyes(spark, sf_dir).filter("vec_id < 12")
    odd = eyes.limit(1).selectExpr("-1L as vec_id", "red", "cast(null as array<bigint>) as green", "blue", "od_x", "od_y", "od_radius", "fovea_x", "fovea_y")
    rows = T.candidate_rows(eyes.unionByName(odd), "vec_id", vision.SIZE, vision.SMALL)
    kept = ["vec_id", "lesion", "cand", "cx", "cy", "area"]
    found = rows.collect()
    plain = S.candidate_rows(eyes, "vec_id", vision.SIZE, vision.SMALL).select(*kept).collect()
    short = lambda r: tuple(round(r[c], 9) if c in ("cx", "cy") else r[c] for c in kept)
    assert sorted(map(short, found)) == sorted(map(short, plain))
    assert len(found) > 20
    assert all((r["dme_touch"] is None) == (r["lesion"] != "hard_exudate") for r in found)
    assert all(r["area_px"] == r["area"] and 0 <= r["eccentricity"] <= 1 and 0 <= r["boundary_smoothness"] <= 1 + 1e-9 for r in found)
    assert rows.columns[6:-1] == list(T.FEATURES)


def test_a_black_image_has_no_candidates(spark):
    black = spark.range(1).selectExpr("id as vec_id", *(f"array_repeat(0, {vision.SIZE**2}) as {c}" for c in ("red", "green", "blue")), "14D as od_x", "30D as od_y", "5D as od_radius", "36D as fovea_x", "33D as fovea_y")
    assert T.candidate_rows(black, "vec_id", vision.SIZE, vision.SMALL).count() == 0


def test_candidates_measured_together_are_those_measured_alone():
    rng = np.random.default_rng(21)
    red, green, blue = (np.floor(rng.uniform(0, 256, (64, 64))) for _ in range(3))
    mask = rng.random((64, 64)) < 0.35
    mask[20:30, 20:30] = True
    mask[24:26, 23:27] = False
    p = T.picture(red, green, blue, rng.random((64, 64)) < 0.05, (30.0, 20.0, 5.0), (50.0, 33.0))
    grounds = green / 255.0, blue
    held = [(grounds[k % 2], *found) for k, found in enumerate(T.regions(mask, 8, *ALL))]
    assert len(held) > 20
    T._KEPT.clear()
    together = T.all_traits(p, held)
    T._KEPT.clear()
    alone = [T.traits(p, *one) for one in held]
    assert np.allclose(together, alone, rtol=1e-9, atol=1e-9) and T.all_traits(p, []) == []
    for region, row in zip((h[3] for h in held), together):
        steps = T.border(T.filled(region))[1]
        want = T.eccentricity(steps) if steps.sum() >= T.LEAST_FITTED else 0.0
        assert row[T.FEATURES.index("eccentricity")] == pytest.approx(want, abs=1e-7)


def test_features_and_candidates_come_from_one_look(spark, sf_dir):
    from gradework.operators import landmarks as M
    from gradework.plans import vision

    images = vision.eyes(spark, sf_dir).select("vec_id", "red", "green", "blue").limit(20)
    features, found = T.parted(T.features_and_candidates(images, "vec_id", vision.SIZE, vision.SMALL), "vec_id")
    for got, want in ((features, M.image_features(images, "vec_id", vision.SIZE, vision.SMALL)), (found, T.located_candidate_rows(images, "vec_id", vision.SIZE, vision.SMALL))):
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
