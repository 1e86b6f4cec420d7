"""Image kernels against pixel loops, known shapes and each reason code."""

import math

import numpy as np
import pytest

from gradework.operators import filters as P
from gradework.operators import images as I
from gradework.operators import landmarks as M
from gradework.operators import spots as S
from gradework.operators import vessels as V
from gradework.operators import view as W

RNG = np.random.default_rng(11)
TINY = V.Scale(matched_sigma=1.0, matched_length=5, sigmas=(1.0, 2.0), fine=(3, 5), coarse=(7, 7), coarse_dilation=3, disc_diameter=8, least_in_quadrant=2)


def mirrored(k, n):
    while not 0 <= k < n:
        k = -k if k < 0 else 2 * (n - 1) - k
    return k


def repeated(k, n):
    while not 0 <= k < n:
        k = -1 - k if k < 0 else 2 * n - 1 - k
    return k


def looped(image, kernel, border):
    h, w = image.shape
    cy, cx = kernel.shape[0] // 2, kernel.shape[1] // 2
    out = np.zeros(image.shape)
    for y in range(h):
        for x in range(w):
            out[y, x] = sum(kernel[a, b] * image[border(y + a - cy, h), border(x + b - cx, w)] for a in range(kernel.shape[0]) for b in range(kernel.shape[1]))
    return out


def picked(image, support, best):
    h, w = image.shape
    cy, cx = support.shape[0] // 2, support.shape[1] // 2
    places = [(a - cy, b - cx) for a, b in zip(*np.nonzero(support))]
    return np.array([[best(image[y + a, x + b] for a, b in places if 0 <= y + a < h and 0 <= x + b < w) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("mode, border", [("mirror", mirrored), ("symmetric", repeated)])
def test_correlation(mode, border):
    image = RNG.random((9, 12))
    kernels = [RNG.random((5, 5)), RNG.random((3, 7)), P.rotated_line(5, 30)]
    for kernel, got in zip(kernels, P.correlated(image, kernels, mode)):
        assert np.allclose(got, looped(image, kernel, border), atol=1e-8)


def test_boxes_and_extremes():
    image = RNG.random((10, 8))
    assert np.allclose(P.box_mean(image, 5), looped(image, np.ones((5, 5)) / 25, mirrored), atol=1e-8)
    even = looped(image, np.pad(np.ones((4, 4)) / 16, ((0, 1), (0, 1))), repeated)
    assert np.allclose(P.box_mean(image, 4, "symmetric"), even, atol=1e-8)
    for support in (P.ellipse(5), P.line_support(5, 60), np.ones((3, 3), dtype=bool)):
        high = picked(image, support, max)
        assert np.array_equal(P.extreme(image, support, True), high)
        assert np.array_equal(P.closed(image, support), picked(high, support, min))
        mask = image > 0.5
        assert np.array_equal(P.extreme(mask, support, True), picked(mask, support, any)) and np.array_equal(P.extreme(mask, support, False), picked(mask, support, all))


def test_supports():
    assert P.ellipse(7).astype(int).tolist()[:4] == [[0, 0, 0, 1, 0, 0, 0], [0, 1, 1, 1, 1, 1, 0], [1] * 7, [1] * 7]
    assert np.array_equal(P.rotated_line(9, 0)[4], np.ones(9)) and P.rotated_line(9, 0).sum() == 9
    assert np.array_equal(P.rotated_line(9, 90), P.rotated_line(9, 0).T)
    slanted = np.fliplr(np.eye(5, dtype=bool))
    slanted[0, 4] = slanted[4, 0] = False  # the line does not reach the corners
    assert np.array_equal(P.line_support(5, 45), slanted)


def test_distances():
    for share in (0.1, 0.5, 0.95):
        mask = RNG.random((17, 23)) < share
        mask[3, 4] = False
        outside = np.argwhere(~mask)
        want = [[min(math.hypot(y - a, x - b) for a, b in outside) for x in range(23)] for y in range(17)]
        assert np.allclose(P.distance(mask), want)
    assert np.isinf(P.distance(np.ones((3, 4), dtype=bool))).all()


def test_stretching_keeps_corners_and_lines():
    ramp = np.add.outer(np.arange(4.0), 10 * np.arange(5.0))
    out = P.stretched(ramp, 10, 9)
    assert out[0, 0] == 0 and out[-1, -1] == ramp[-1, -1] and np.allclose(np.diff(out, 2, axis=1), 0)


def test_curvature_of_a_parabola():
    y, x = np.mgrid[0:61, 0:61].astype(float) - 30
    xx, yy, xy = next(P.curvature(3 * x**2 + 2 * x * y - y**2, np.array([2.0])))
    assert np.allclose([xx[30, 30] / 4, yy[30, 30] / 4, xy[30, 30] / 4], [6, -2, 2], rtol=0.02)


# ---- vessels


def line_image(size, half_width, bright=180.0):
    image = np.full((size, size), bright)
    middle = size // 2
    image[middle - half_width : middle + half_width + 1, 4:-4] -= 90
    return image


def test_width_comes_from_the_scale_of_the_ridge():
    s = V.Scale(sigmas=tuple(np.linspace(1, 6, 21)))
    found = [V.ridges(line_image(64, k), s)[1][32, 32] for k in (1, 2, 4)]
    assert found == sorted(found) and found[0] < found[-1]
    assert V.calibre(np.array([[0.9, 1.0, 1.5, 3.0, 4.0]]), np.ones((1, 5), dtype=bool), V.Scale()).tolist() == [[V.NONE, V.MINOR, V.FIRST_BRANCH, V.MAJOR, V.BEADING]]


def test_bright_ridges_answer_nothing():
    assert V.ridges(255 - line_image(48, 1), V.Scale(sigmas=(2.0,)))[0][24, 24] == 0


def looped_excess(image, s):
    """The definition of the excess, pixel by pixel."""

    def strong(length, width):
        dark = 1 - image
        answers = [looped(dark, k / k.sum(), mirrored) for k in (P.rotated_line(length, 180 * a / s.orientations) for a in range(s.orientations))]
        value = np.round(np.max(answers, axis=0), 9) - np.round(looped(dark, np.ones((width, width)) / width**2, mirrored), 9)
        return value > np.percentile(value, s.excess_percentile)

    return strong(*s.fine) & ~picked(strong(*s.coarse), np.ones((s.coarse_dilation,) * 2), any)


def test_excess_against_loops():
    for _ in range(4):
        image = RNG.random((14, 14))
        got = V.line_excess(image, np.ones(image.shape, dtype=bool), TINY)
        assert got.any() and np.array_equal(got, looped_excess(image, TINY))


def test_matched_filter_against_loops():
    image = RNG.random((13, 13)) * 255
    bank = [looped(image, V.matched_kernel(1.0, 5, math.pi * k / 12), mirrored) for k in range(12)]
    best = np.round(np.max(bank, axis=0), 9)
    view = V.round_view(13, 0.95)
    assert np.array_equal(V.matched_map(image, view, TINY), (best > np.percentile(best[view], 90)) & view)


def test_coherence_of_stripes_and_of_noise():
    stripes = np.tile(np.sin(np.arange(40.0)), (40, 1))
    assert V.coherence(stripes)[10:-10, 10:-10].min() > 0.99 and V.coherence(RNG.random((40, 40)))[10:-10, 10:-10].mean() < 0.6
    assert (V.coherence(np.zeros((9, 9))) == 0).all()


def test_lengths_of_trees():
    mask = np.zeros((20, 40), dtype=bool)
    mask[3, 2:32] = True
    mask[10:13, 5:25] = True
    area, length = V.tree_lengths(mask)
    assert area.tolist() == [30, 60]
    assert length[0] == 30 / 4  # a line one pixel wide: every pixel is at distance 1
    inside = sum(min(y - 9, 13 - y, x - 4, 25 - x) for y in range(10, 13) for x in range(5, 25))
    assert length[1] == pytest.approx(60 / (4 * inside / 60))


def test_new_vessels_are_split_by_place():
    image = np.full((64, 64), 150.0) + RNG.normal(0, 0.01, (64, 64))
    for cy, cx in ((20, 20), (44, 46)):
        image[cy - 2 : cy + 3, cx] -= 60
        image[cy, cx - 2 : cx + 3] -= 60
    s = V.Scale(matched_sigma=1.0, matched_length=5, sigmas=(1.0, 2.0), fine=(5, 7), coarse=(21, 21), coarse_dilation=3, disc_diameter=10, least_in_quadrant=2, excess_percentile=99.0)
    out = V.measured(image, (20.0, 20.0), (40.0, 20.0), s)
    assert out["nvd_count"] >= 1 and out["nve_count"] >= 1 and 0 < out["nvd_score"] < out["nv_score"]
    assert out["nve_score"] == pytest.approx(out["nv_score"] - out["nvd_score"]) and set(out) == set(V.VESSEL_COLUMNS)


def test_black_image_has_no_vessels():
    out = V.measured(np.zeros((32, 32)), (16.0, 16.0), (20.0, 16.0), TINY)
    assert out["vessel_components"] == 0 and out["vessel_length"] == 0 and out["nv_score"] == 0 and not any(map(math.isnan, out.values()))


# ---- spots


def test_small_dark_spots_against_loops():
    shade = np.clip(0.6 + RNG.normal(0, 0.05, (20, 20)), 0, 1)
    shade[6:8, 6:8] = 0.2
    vessels = np.zeros((20, 20), dtype=bool)
    vessels[15, 3:17] = True
    view = V.round_view(20, 0.92)
    levels = np.floor(shade * 255)
    closings = []
    for k in range(12):
        support = P.line_support(5, 15.0 * k)
        closings.append(picked(picked(levels, support, max), support, min))
    gap = (np.min(closings, axis=0) - levels) / 255
    gap[picked(vessels, np.ones((7, 7)), any) | ~view] = 0
    want = gap > max(np.percentile(gap[view], 95), 1e-4)
    got = S.small_dark(shade, vessels, view, 5, 95)
    assert np.array_equal(got, want) and got[6:8, 6:8].all() and not got[12:19].any()
    assert not S.small_dark(np.full((20, 20), 0.5), vessels, view, 5, 95).any()


def test_top_hat_and_vessels_against_loops():
    image = RNG.random((16, 16)) * 255
    mask = RNG.random((16, 16)) > 0.2
    gap = picked(picked(image, P.ellipse(5), max), P.ellipse(5), min) - image
    assert np.array_equal(S.top_hat(image, mask, 5), (gap > np.percentile(gap[mask], 95)) & mask)
    vessels = RNG.random((16, 16)) > 0.97
    assert np.array_equal(S.without_vessels(mask, vessels), mask & ~picked(vessels, P.ellipse(7), any))
    assert not S.top_hat(image, np.zeros((16, 16), dtype=bool), 5).any()


def test_shade_correction_against_loops():
    green = RNG.random((30, 30)) * 255
    mask = V.round_view(30, 0.9)
    t = np.arange(-4, 5)
    bell = np.exp(-(t**2) / 2.0)
    bell /= bell.sum()
    assert np.allclose(S.shade_corrected(green, mask), green - looped(green, np.outer(bell, bell), mirrored) + green[mask].mean(), atol=1e-6)


def test_ratio_spots_against_loops():
    red, green, blue = (np.floor(RNG.random((32, 32)) * 256) for _ in range(3))
    blue[10:16, 10:16] = 250
    green[20:28, 20:28] = 30
    mask = np.ones((32, 32), dtype=bool)
    nine, wide = np.ones((9, 9)) / 81, np.ones((27, 27)) / 729
    ratio = looped(blue, nine, mirrored) / (looped(green, nine, mirrored) + 1e-6)
    over = ratio - looped(ratio, wide, mirrored)
    assert np.array_equal(S.ratio_spots(red, green, blue, mask, "cws"), over > 0.05)
    assert np.array_equal(S.ratio_spots(red, green, blue, mask, "haem"), -over > 0.05)
    most, least = np.max([red, green, blue], axis=0), np.min([red, green, blue], axis=0)
    sat = np.floor(255 * (most - least) / np.maximum(most, 1) + 0.5) / 255
    assert np.allclose(S.saturation(red, green, blue), sat, atol=1.01 / 255)
    assert np.array_equal(S.ratio_spots(red, green, blue, mask, "hard_exudate"), looped(S.saturation(red, green, blue), nine, mirrored) > 0.35)


def test_spots_are_joined_and_kept_by_area():
    mask = np.zeros((6, 8), dtype=bool)
    mask[0, 0] = mask[1, 1] = mask[2, 2] = True
    mask[4, 4:7] = True
    assert S.spots(mask, 8, 3) == [(1.0, 1.0, 3), (5.0, 4.0, 3)]
    assert S.spots(mask, 4, 1, 2) == [(0.0, 0.0, 1), (1.0, 1.0, 1), (2.0, 2.0, 1)] and S.spots(np.zeros((3, 3), dtype=bool), 8, 1) == []


def test_candidates_leave_disc_fovea_and_vessels_alone():
    size = 96
    red, green, blue = np.full((size, size), 160.0), np.full((size, size), 140.0), np.full((size, size), 70.0)
    for cy, cx in ((40, 64), (60, 30)):
        blue[cy - 5 : cy + 6, cx - 5 : cx + 6] = 150
    shade = np.full((size, size), 0.5)
    shade[22:24, 50:52] = 0.2
    vessels = np.zeros((size, size), dtype=bool)
    view = V.round_view(size, 0.92)
    found = S.candidates(red, green, blue, shade, vessels, view, (30.0, 60.0, 10.0), (48.0, 48.0))
    pale = [(round(x), round(y)) for lesion, x, y, _ in found if lesion == "cws"]
    assert pale == [(64, 40)] and [(x, y, a) for lesion, x, y, a in found if lesion == "ma"] == [(50.5, 22.5, 4)]


# ---- bridges


def test_bridges_join_two_parts_only():
    mask = np.zeros((11, 21), dtype=bool)
    mask[5, 2:9] = mask[5, 12:19] = True
    out = S.bridged(mask, 9)
    assert out[5, 9:12].all() and out.sum() == mask.sum() + 3
    notch = np.zeros((11, 11), dtype=bool)
    notch[3, 2:9] = True
    notch[3, 5] = False
    notch[4:6, 4:7] = True
    notch[4, 5] = False  # a hole inside one part
    notch[9, 9] = True  # another part, far away
    assert np.array_equal(S.bridged(notch, 3), notch)
    for same in (np.zeros((5, 5), dtype=bool), np.ones((5, 5), dtype=bool)):
        assert np.array_equal(S.bridged(same, 9), same)


# ---- views


def disc(size, cx, cy, r, level=0.8, ground=0.0):
    y, x = np.mgrid[0:size, 0:size]
    return np.where(np.hypot(y - cy, x - cx) <= r, level, ground)


@pytest.mark.parametrize("cx, cy, r", [(60, 60, 45), (50.5, 64.25, 40), (60, 60, 58), (90, 60, 50)])
def test_known_circles_are_found(cx, cy, r):
    view, why, degenerate, retried = W.find_view(disc(120, cx, cy, r))
    assert why == "ok" and not degenerate
    assert abs(view["cx"] - cx) < 1 and abs(view["cy"] - cy) < 1 and abs(view["r"] - r) < 1 and view["residual"] < 0.02


def test_outliers_of_the_edge_are_left_out():
    image = disc(160, 80, 80, 50)
    image[72:88, 128:144] = 0.8  # a lit tab at the side
    view, *_ = W.find_view(image)
    assert abs(view["cx"] - 80) < 2 and abs(view["r"] - 50) < 2 and view["residual"] > 0.02


def test_holes_are_filled_and_crumbs_dropped():
    image = disc(120, 60, 60, 45)
    image[50:60, 50:60] = 0
    image[2:5, 2:5] = 0.8
    view, *_ = W.find_view(image)
    assert view["mask_px"] == pytest.approx(math.pi * 45**2, rel=0.01)


def test_every_reason():
    lines = np.zeros((120, 120))
    lines[::12] = 0.9
    cases = {
        "empty_after_thresh": np.where(disc(120, 60, 60, 3) > 0, 0.9, 0.0),
        "mask_gt_98pct": np.full((120, 120), 0.9) - 0.8 * disc(120, -5, -5, 9, 1.0),
        "too_small_after_open": lines,
        "too_few_boundary": disc(120, 60, 60, 7),
        "R_out_of_range": disc(1200, 600, 600, 30),
    }
    for reason, image in cases.items():
        assert W.view_at(image, 0.5)[1] == reason, reason
    view, why, _, _ = W.find_view(cases["too_few_boundary"])
    assert view is None and why == "otsu:too_few_boundary/fallback:too_few_boundary"


def test_second_fit_may_fail(monkeypatch):
    fits = iter([(60.0, 60.0, 45.0), None])
    monkeypatch.setattr(W, "fitted_circle", lambda x, y: next(fits))
    assert W.view_at(disc(120, 60, 60, 45), 0.5) == (None, "R_out_of_range2")


def test_ragged_views_are_tried_again():
    image = disc(160, 80, 80, 60, 0.36)
    y, x = np.mgrid[0:160, 0:160]
    comb = ((x // 12) % 2 == 0) | (np.abs(y - 80) < 7)
    image = np.where((image > 0) & comb, 0.9, image)
    view, why, _, retried = W.find_view(image)
    first, _ = W.view_at(image, W.two_class_threshold(image))
    assert retried and why == "ok" and abs(view["r"] - 60) < 2 and (first is None or first["raggedness"] > view["raggedness"])


def test_flat_red_falls_back_to_the_brightest_channel():
    view, why, degenerate, _ = W.find_view(np.full((120, 120), 0.5), disc(120, 60, 60, 45))
    assert degenerate and why == "ok" and abs(view["r"] - 45) < 1
    assert W.find_view(np.zeros((120, 120)), np.zeros((120, 120)))[0] is None


def test_collinear_points_have_no_circle():
    assert W.fitted_circle(np.arange(60.0), np.full(60, 3.0)) is None


# ---- arrays in Spark


def test_images_of_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, []), (4, [1.0, None]), (5, [5.0, 6.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    out = I.per_image(df, ["v"], ["k"], 2, lambda image, k: [(float(image.sum()), image.shape[0])] * image.shape[0], "total double, lines int")
    assert sorted(map(tuple, out.collect())) == [(1, 10.0, 2), (1, 10.0, 2), (5, 11.0, 1)]
    assert I.per_image(df.limit(0), ["v"], ["k"], 2, lambda image, k: [], "total double").count() == 0


def test_rows_of_queries(spark, sf_dir):
    from gradework.plans import vision

    few = vision.eyes(spark, sf_dir).limit(4)
    eyes = {r["vec_id"]: r for r in few.collect()}
    for r in V.vessel_rows(few, "vec_id", vision.SIZE, vision.SMALL).collect():
        e = eyes[r["vec_id"]]
        want = V.measured(np.array(e["green"], dtype=float).reshape(64, 64), (e["od_x"], e["od_y"]), (e["fovea_x"], e["fovea_y"]), vision.SMALL, e["od_radius"])
        assert r.asDict() == pytest.approx({"vec_id": r["vec_id"], **want})
    spots = S.candidate_rows(few, "vec_id", vision.SIZE, vision.SMALL).collect()
    assert {r["vec_id"] for r in spots} == set(eyes) and all(0 <= r["cx"] < 64 and r["area"] >= 3 for r in spots)
    assert V.vessel_rows(few.withColumn("od_x", few["od_x"] * None), "vec_id", vision.SIZE, vision.SMALL).count() == 0


# ---- landmarks


def eye(size=200, disc_at=(55, 100), fovea_at=(125, 104), r=12):
    """A reddish round view with a bright disc and a dark fovea."""
    y, x = np.mgrid[0:size, 0:size]
    base = 100 + 8 * np.exp(-((x - size / 2) ** 2 + (y - size / 2) ** 2) / 9000)
    bright = np.hypot(x - disc_at[0], y - disc_at[1]) <= r
    dark = 35 * np.exp(-((x - fovea_at[0]) ** 2 + (y - fovea_at[1]) ** 2) / 120)
    return tuple(np.where(bright, level, base * share - dark) for level, share in ((240, 1.2), (220, 1.0), (180, 0.7)))


def test_disc_and_fovea_are_found():
    red, green, blue = eye()
    retina = V.round_view(200, 0.95)
    disc = M.find_disc(red, green, blue, np.zeros((200, 200), dtype=bool), retina)
    assert math.hypot(disc.x - 55, disc.y - 100) <= 8 and disc.contrast > 50
    fovea = M.find_fovea(M.brightness(red, green, blue), M.Disc(55.0, 100.0, 12.0, 90.0, True), retina)
    assert math.hypot(fovea.x - 125, fovea.y - 104) < 6 and fovea.brighter_outward


def test_vessels_do_not_darken_the_disc():
    red, green, blue = eye(r=12)
    vessels = np.zeros((200, 200), dtype=bool)
    vessels[:, 52:58] = True
    for c in (red, green, blue):
        c[vessels] = 10
    retina = V.round_view(200, 0.95)
    apart = M.find_disc(red, green, blue, vessels, retina)
    assert math.hypot(apart.x - 55, apart.y - 100) <= 12  # any place of an even disc is as bright as its middle


def test_round_means_against_loops():
    image, valid = RNG.random((11, 12)), RNG.random((11, 12)) > 0.3
    support = P.ellipse(5)
    edge = lambda k, n: min(max(k, 0), n - 1)
    want = looped(np.where(valid, image, 0), support, edge) / np.maximum(looped(valid.astype(float), support, edge), 1e-6)
    assert np.allclose(M.round_means(image, valid, 2.2), want, atol=1e-7)


def test_a_fan_outside_the_view_gives_the_expected_place():
    image = np.full((60, 60), 100.0)
    fovea = M.find_fovea(image, M.Disc(30.0, 30.0, 40.0, 9.0, False), np.zeros((60, 60), dtype=bool))
    assert (fovea.x, fovea.y, fovea.brighter_outward) == (30.0 + 2.4 * 80, 30.0, False) and math.isnan(fovea.darkness)


def test_rows_of_the_second_stage(spark):
    red, green, blue = (c.ravel().tolist() for c in eye(64, (18, 32), (42, 33), 4))
    df = spark.createDataFrame([(1, red, green, blue), (2, None, green, blue)], "k int, red array<double>, green array<double>, blue array<double>")
    features = M.image_features(df, "k", 64, TINY)
    row = features.collect()
    assert len(row) == 1 and math.hypot(row[0]["od_x"] - 18, row[0]["od_y"] - 32) <= 4 + row[0]["od_radius"] and row[0]["od_radius_pct"] == pytest.approx(100 * row[0]["od_radius"] / 32)
    kept = spark.createDataFrame([(1, "haem", 30.0, 30.0, 9.0), (1, "hard_exudate", row[0]["fovea_x"], row[0]["fovea_y"], 4.0)], "k int, lesion string, cx double, cy double, area double")
    out = M.stage2_rows(features, kept, "k", 2000.0)
    assert out.columns == ["k", *M.STAGE2_COLUMNS] and len(M.STAGE2_COLUMNS) == 45
    got = out.first()
    assert (got["haem_count"], got["hard_exudate_count"], got["dme_flag"], got["ma_count"], got["exudate_fovea_min_dist_dd"]) == (1, 1, 1, 0, 0.0)
    assert M.stage2_rows(features, kept.limit(0), "k", 2000.0).first()["haem_count"] == 0


@pytest.mark.parametrize("length", [3, 9, 15, 41])
def test_bytes_and_masks_have_the_extremes_of_numbers(length):
    levels = RNG.integers(0, 256, (20, 31))
    for support in (*(P.line_support(length, 15.0 * k) for k in range(12)), P.ellipse(length), np.ones((length, 3), dtype=bool)):
        for highest in (True, False):
            want = P.extreme(levels.astype(float), support, highest)
            got = P.extreme(levels.astype(np.uint8), support, highest)
            assert got.dtype == np.uint8 and (got == want).all()
            assert (P.extreme(levels > 200, support, highest) == P.extreme((levels > 200).astype(float), support, highest)).all()


def test_small_images_are_filtered_as_large_ones(monkeypatch):
    image = np.floor(RNG.uniform(0, 256, (30, 41)))
    kernels = [RNG.normal(size=(3, 3)), RNG.normal(size=(9, 9)), RNG.normal(size=(5, 5))]
    mask = RNG.random((30, 41)) < 0.9

    def all_of():
        bank = [x for mode in ("mirror", "symmetric", "edge") for x in (*P.correlated(image, kernels, mode), *P.correlated(image, kernels[:1], mode))]
        blurred = [P.gaussian(image, 2.0), P.gaussian(image, 1.5, 4, "mirror"), *(x for part in P.curvature(image, np.array([1.0, 3.0])) for x in part)]
        return [*bank, *blurred, P.box_mean(image, 9), P.box_mean(image, 18, "symmetric"), P.distance(mask), P.distance(np.ones_like(mask))]

    small = all_of()
    for name in ("KEPT_PIXELS", "DIRECT_STEPS"):
        monkeypatch.setattr(P, name, 0)
    for one, other in zip(small, all_of()):
        assert np.allclose(one, other, atol=2e-9)
    for share in (0.0, 37.5, 90.0, 100.0):
        assert P.percentile(image[mask], share) == np.percentile(image[mask], share)


def test_long_narrow_images_make_no_square_matrices():
    strip = RNG.random((1, 20_000))
    for small, out in ((strip[:, :200], lambda x: P.gaussian(x, 2.0)), (strip[:, :200], lambda x: P.box_mean(x, 5, "symmetric"))):
        assert np.allclose(out(strip)[:, :150], out(small)[:, :150], atol=2e-9)
    assert not P._small(strip) and P._small(strip[:, :200])
