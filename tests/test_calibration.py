"""Exact percentiles, thresholds, cut points, illumination and samples against numpy and plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradework.functions import ordered as O
from gradework.operators import grading as M
from gradework.operators import illumination as L
from gradework.operators import metrics as E
from gradework.operators import sampling as S


def test_percentiles_of_groups_with_ties_and_nulls(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([None, 1.0, 2.0, rng.random() * 9]), float(rng.randrange(5))) for _ in range(900)] + [("one", 7.5, None), (None, 1.0, 2.0), (None, 4.0, 3.0)]
    shares = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]
    got = O.percentiles(spark.createDataFrame(rows, "g string, p double, q double"), ["p", "q"], shares, ["g"]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for k, name in ((1, "p"), (2, "q")):
            values = [r[k] for r in rows if r[0] == g and r[k] is not None]
            want |= {(g, name, x): (len(values), np.quantile(values, x)) for x in shares if values}
    assert {(r["g"], r["metric"], r["share"]): (r["n"], pytest.approx(r["value"])) for r in got} == want


def test_percentiles_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(5.0,)] * 40, "v double")
    assert [(r["n"], r["value"]) for r in O.percentiles(df, ["v"], [0.1, 0.9]).collect()] == [(40, 5.0)] * 2
    assert O.percentiles(df.limit(0), ["v"], [0.5]).count() == 0


def test_no_buffer_of_a_column_in_percentiles(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("v"))
    plan = O.percentiles(df, ["v"], [0.5])._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_list" not in plan


def test_neighbours(spark):
    values = sorted({random.Random(1).randrange(10_000) / 7 for _ in range(500)})
    df = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "v double")
    assert sorted((r["v"], r["next"]) for r in O.neighbours(df, "v").collect() if r["next"] is not None) == list(zip(values, values[1:]))
    assert O.neighbours(df, "v").filter("next is null").collect()[0]["v"] == values[-1]


def test_thresholds_of_strata(spark):
    rows = [("big", float(k), float(k * k)) for k in range(30)] + [("small", 1.0, 2.0)] * 19 + [(None, 500.0, 1.0)]
    metrics = {"a": {"a_fail": 0.02}, "b": {"b_fail": 0.02, "b_borderline": 0.1}}
    got = {r["s"]: r for r in E.stratum_thresholds(spark.createDataFrame(rows, "s string, a double, b double"), "s", metrics).collect()}
    assert set(got) == {"big", "pooled"} and got["pooled"]["n"] == 50
    assert got["big"]["a_fail"] == pytest.approx(np.quantile(range(30), 0.02)) and got["big"]["b_borderline"] == pytest.approx(np.quantile([k * k for k in range(30)], 0.1))
    assert got["pooled"]["a_fail"] == pytest.approx(np.quantile([r[1] for r in rows], 0.02))


def test_profile_counts_rejected_rows(spark):
    rows = [("x", 1.0, True), ("x", 3.0, False), ("x", None, None), ("y", 5.0, False)]
    got = {r["g"]: r for r in E.profile(spark.createDataFrame(rows, "g string, m double, bad boolean"), "g", ["m"], "bad").collect()}
    assert (got["x"]["n"], got["x"]["middle"], got["x"]["rejected_pct"]) == (2, 2.0, pytest.approx(100 / 3))
    assert (got["ALL"]["n"], got["ALL"]["most"], got["ALL"]["rejected_pct"]) == (3, 5.0, 25.0)


def kappa(truth, predicted, classes=5):
    matrix = np.zeros((classes, classes))
    for t, p in zip(truth, predicted):
        matrix[t, p] += 1
    gap = np.subtract.outer(np.arange(classes), np.arange(classes)) ** 2
    expected = np.outer(matrix.sum(1), matrix.sum(0)) / matrix.sum()
    return 1 - (gap * matrix).sum() / (gap * expected).sum() if (gap * expected).sum() else math.nan


def climbed(scores, truth, most=400):
    """Cut points as the definition says, over all rows."""
    scores, truth = np.array(scores), np.array(truth)
    assign = lambda cuts: (scores[:, None] > np.array(cuts)[None]).sum(axis=1)
    cuts = sorted(np.quantile(scores, np.cumsum(np.bincount(truth, minlength=5))[:-1] / len(truth)))
    distinct = np.unique(scores)
    places = (distinct[:-1] + distinct[1:]) / 2 if len(distinct) > 1 else distinct
    if len(places) > most:
        places = np.quantile(places, np.linspace(0, 1, most))
    best = kappa(truth, assign(cuts))
    moved = True
    while moved:
        moved = False
        for k in range(4):
            low, high = cuts[k - 1] if k else -math.inf, cuts[k + 1] if k < 3 else math.inf
            for place in places:
                if low <= place <= high:
                    trial = [*cuts[:k], place, *cuts[k + 1 :]]
                    if (value := kappa(truth, assign(trial))) > best + 1e-12:
                        best, cuts, moved = value, trial, True
    return cuts, best


@pytest.mark.parametrize("n, most, spread", [(120, 400, 0.9), (150, 25, 0.7)])
def test_cut_points_are_those_of_the_definition(spark, n, most, spread):
    rng = np.random.default_rng(n)
    truth = rng.integers(0, 5, n)
    scores = np.round(truth * 0.6 + rng.normal(0, spread, n), 2)  # some scores are tied
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(scores, truth)], "score double, grade int")
    cuts = M.fit_cutpoints(df, "score", "grade", candidates=most)
    want, best = climbed(scores, truth, most)
    assert cuts == pytest.approx(want)
    assert kappa(truth, (scores[:, None] > np.array(cuts)[None]).sum(axis=1)) == pytest.approx(best)


def test_cut_points_of_odd_input(spark):
    df = spark.createDataFrame([(1.0, 2)], "score double, grade int")
    assert M.fit_cutpoints(df.limit(0), "score", "grade") == list(M.DEFAULT_CUTS)
    assert M.fit_cutpoints(df, "score", "grade") == [1.0] * 4
    assert M.cut_candidates(df, "score") == [1.0]
    many = spark.range(1000).select((F.col("id") / 3.0).alias("score"))
    values = np.arange(1000) / 3
    assert M.cut_candidates(many, "score") == pytest.approx(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, 400)))


@pytest.mark.parametrize("shape", ["plane", "radial"])
def test_illumination_against_least_squares(spark, shape):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:14, 0:20].astype(float)
    inside = np.hypot(y - 6, x - 9) < 6.2
    v = (0.02 * x - 0.03 * y + 0.5 if shape == "plane" else 0.9 - 0.004 * np.hypot(y - 6, x - 9) ** 2) + rng.normal(0, 0.01, x.shape)
    rows = [(1, v.ravel().tolist(), inside.ravel().tolist()), (2, [0.5] * 280, [False] * 280), (3, v.ravel().tolist(), [k < 12 for k in range(280)])]
    got = {r["k"]: r for r in L.illumination(spark.createDataFrame(rows, "k int, v array<double>, i array<boolean>"), "k", "v", 20, "i").collect()}
    ys, xs = np.nonzero(inside)
    u, w, values = xs - xs.mean(), ys - ys.mean(), v[inside]
    plane, *_ = np.linalg.lstsq(np.column_stack([u, w, np.ones(len(u))]), values, rcond=None)
    r = np.hypot(u, w)
    radial = np.polyfit(r / (r.max() + 1e-6), values, 2)
    out = got[1]
    assert [out["plane_x"], out["plane_y"], out["plane_0"]] == pytest.approx(plane.tolist())
    assert [out["radial_2"], out["radial_1"], out["radial_0"]] == pytest.approx(radial.tolist())
    errors = [np.mean((values - np.column_stack([u, w, np.ones(len(u))]) @ plane) ** 2), np.mean((values - np.polyval(radial, r / (r.max() + 1e-6))) ** 2)]
    assert [out["plane_error"], out["radial_error"]] == pytest.approx(errors) and out["model"] == shape
    radius = math.sqrt(len(u) / math.pi)
    assert out["tilt"] == pytest.approx(math.hypot(*plane[:2]) * radius) and out["falloff"] == pytest.approx(np.polyfit(r, values, 1)[0] * radius)
    assert 2 not in got and got[3]["plane_x"] is None and got[3]["falloff"] is not None  # twelve pixels of one row have no plane


def test_points_and_squares_stay_inside(spark):
    frames = spark.createDataFrame([(k, 20 + 9 * k, 60) for k in range(6)], "k int, h int, w int")
    points = S.points_in_disc(frames, "k", "h", "w").collect()
    squares = S.squares_in_disc(frames, "k", "h", "w").collect()
    for k in range(6):
        h, w, radius = 20 + 9 * k, 60, 0.375 * (20 + 9 * k)
        own = [r for r in points if r["k"] == k]
        assert [r["nth"] for r in sorted(own, key=lambda r: r["nth"])] == list(range(len(own))) and 0 < len(own) <= round(math.pi * radius**2 * 0.1)
        assert all(2 <= r["y"] < h - 2 and 2 <= r["x"] < w - 2 and math.hypot(r["y"] - h // 2, r["x"] - w // 2) <= radius + 1.5 for r in own)
        boxes = [r for r in squares if r["k"] == k]
        side = max(4, round(math.sqrt(math.pi * radius**2 * 0.025)))
        assert len(boxes) == 8 and all(r["y1"] - r["y0"] == side == r["x1"] - r["x0"] and r["y0"] >= 0 and r["x1"] < w for r in boxes)
    assert S.points_in_disc(frames, "k", "h", "w").collect() == points and S.points_in_disc(frames, "k", "h", "w", seed=1).collect() != points


def test_points_are_even_over_the_area(spark):
    frames = spark.range(40).select("id", F.lit(200).alias("h"), F.lit(200).alias("w"))
    inner = [math.hypot(r["y"] - 100, r["x"] - 100) < 75 / math.sqrt(2) for r in S.points_in_disc(frames, "id", "h", "w").collect()]
    assert abs(sum(inner) / len(inner) - 0.5) < 0.01


def test_oversampling_reaches_the_commonest_class(spark):
    rows = [(k, "common") for k in range(300)] + [(1000 + k, "rare") for k in range(7)] + [(5000, None)]
    out = S.oversampled(spark.createDataFrame(rows, "k int, c string"), "c", "k").collect()
    assert {c: sum(r["c"] == c for r in out) for c in ("common", "rare")} == {"common": 300, "rare": 300}
    assert {r["k"] for r in out if r["c"] == "rare"} == {1000 + k for k in range(7)} and len({(r["c"], r["draw"]) for r in out}) == 600
    assert 150 < len({r["k"] for r in out if r["c"] == "common"}) < 240  # with replacement: about 63 % appear
    assert S.oversampled(spark.createDataFrame([], "k int, c string"), "c", "k").count() == 0
