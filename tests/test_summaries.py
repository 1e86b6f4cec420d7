"""Reports, joins of the dataset, gates and calibrations on odd input and against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradework.operators import gates as G
from gradework.operators import grading as M
from gradework.operators import lesion as L
from gradework.operators import relational as R
from gradework.operators import summaries as U
from gradework.operators import vessels as V
from gradework.operators import view as W


def test_masked_summary_of_groups(spark):
    rows = [("a", 1.0, True), ("a", 2.0, True), ("a", 9.0, False), ("a", 4.0, None), ("b", 5.0, False), (None, 3.0, True)]
    got = {r["g"]: r for r in U.masked_summary(spark.createDataFrame(rows, "g string, v double, m boolean"), ["g"], "v", F.col("m"), {"p50": 0.5, "p90": 0.9}).collect()}
    a = got["a"]
    assert (a["mean"], a["spread"], a["variance"], a["top"], a["fraction"], a["p50"], a["p90"]) == (1.5, 0.5, 0.25, 2.0, 0.5, 1.5, pytest.approx(1.9))
    assert got["b"]["mean"] is None and got["b"]["p50"] is None and got["b"]["fraction"] == 0 and got[None]["p90"] == 3.0


def test_histograms_are_dense(spark):
    df = spark.createDataFrame([(0, 1.5), (2, 1.0), (2, 2.0), (7, 9.0), (None, 1.0)], "b int, w double")
    assert [r["n"] for r in U.histogram(df, F.col("b"), 4).orderBy("bin").collect()] == [1, 0, 2, 0]
    assert [r["n"] for r in U.histogram(df, F.col("b"), 4, F.col("w")).orderBy("bin").collect()] == [1.5, 0.0, 3.0, 0.0]
    assert [r["n"] for r in U.histogram(df.limit(0), F.col("b"), 2).collect()] == [0, 0]


def test_reports_by_group(spark):
    df = spark.createDataFrame([("x", "F", 1.0), ("x", "O", None), (None, "F", 2.0), ("y", None, 3.0)], "g string, k string, v double")
    assert {r["grade"]: r["n"] for r in U.rejections(df, F.col("v") > 1.5, "g").collect()} == {"?": 1, "y": 1}
    got = {r["g"]: (r["n_f"], r["n_o"], r["total"], r["share_f"]) for r in U.balance(df.filter("k is not null"), "g", "k", ["F", "O"], "F").collect()}
    assert got == {"x": (1, 1, 2, 50.0), None: (1, 0, 1, 100.0)}
    assert [r["v"] for r in U.usable(df, F.col("g"), ["x", "y"], "v", F.col("k") != "F").collect()] == [3.0]
    assert [r["share"] for r in U.cumulative_shares(df.filter("g is not null"), "g").orderBy("g").collect()] == [pytest.approx(2 / 3), 1.0]


def test_band_percentages_count_measured_rows(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 1, True), (1, 1, False), (2, 1, False)], "k int, b int, m boolean")
    got = {r["k"]: (r["zero"], r["one"]) for r in U.band_percentages(df, "k", F.col("b"), {0: "zero", 1: "one"}, F.col("m")).collect()}
    assert got == {1: (50.0, 50.0), 2: (0.0, 0.0)}


def test_largest_component_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 3), (1, 3), (1, 9)], "k int, component long")
    assert [tuple(r) for r in U.largest_component(df, "k").collect()] == [(1, 3, 2)]


def test_dataset_has_empty_texts_and_no_rejected_images(spark):
    features = spark.createDataFrame([("a", 1.0, "pass"), ("b", 2.0, " Fail"), ("c", 3.0, None), ("a", 4.0, "borderline")], "id string, f double, verdict string")
    labels = spark.createDataFrame([("a", 2), ("z", 1)], "id string, diagnosis int")
    splits = spark.createDataFrame([("c", "dev", 3)], "id string, split string, cv_fold int")
    got = sorted(tuple(r) for r in R.dataset(features, labels, splits, "id", ["split", "cv_fold"], "verdict").select("id", "f", "diagnosis", "split", "cv_fold").collect())
    assert got == [("a", 1.0, "2", "", ""), ("a", 4.0, "2", "", ""), ("c", 3.0, "", "dev", "3")]


def test_backfill_keeps_rows_and_order(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "id string, ratio int, last int")
    out = R.backfilled(df, spark.createDataFrame([("b", 0.5)], "id string, extra double"), "id", "ratio")
    assert out.columns == ["id", "ratio", "extra", "last"] and sorted(map(tuple, out.collect())) == [("a", 1, "", 2), ("b", 3, "0.5", 4)]
    for more, after in ((df.select("id", "last"), "ratio"), (df.select("id", F.lit(1).alias("new")), "absent")):
        with pytest.raises(ValueError):
            R.backfilled(df, more, "id", after)


def test_measurable_images(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("c", 0, 0), ("d", 1, 0), ("e", None, 0)], "id string, fov_ok int, gate_reject int")
    ids = lambda rows: [r["id"] for r in rows.orderBy("id").collect()]
    assert ids(R.measurable(df, "id")) == ["a", "d"] and ids(R.measurable(df, "id", limit=1)) == ["a"]
    assert ids(R.measurable(df, "id", spark.createDataFrame([("d",), ("d",), ("b",)], "id string"))) == ["d"]


def test_gates_of_views(spark):
    rows = [(0.06, 0.5, 0.35, 0.8), (0.07, 0.4, 0.4, 0.9), (None, None, 0.36, None)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(G.fast_reject(*map(F.col, "abcd")).alias("g")).select("g.*").collect()]
    assert got == [(False, ""), (True, "residual|areaFrac|offset|borderFrac"), (True, "offset")]
    row = spark.range(1).select(G.saturated_green(F.lit(0.05)).alias("a"), G.saturated_green(F.lit(0.051)).alias("b"), G.sharp_enough(F.lit(0.082)).alias("c"), G.sharp_enough(F.lit(None).cast("double")).alias("d")).first()
    assert tuple(row) == (False, True, True, False)


def test_black_rows(spark):
    good = [0.0] * 4 + [200.0] * 16  # a fifth of the row is black: inside the band of a square image
    rows = [(1, good * 20), (2, [200.0] * 400), (3, good * 18 + [200.0] * 40), (4, []), (5, None)]
    got = {r["k"]: r for r in W.black_rows(spark.createDataFrame(rows, "k int, brightest array<double>"), "k", 20).collect()}
    assert set(got) == {1, 2, 3} and got[1]["passed"] and got[1]["rows_seen"] == 2 and got[1]["in_band_share"] == 1.0 and not got[2]["passed"]
    assert got[3]["passed"] == (got[3]["in_band_share"] >= 0.8)


def test_tree_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.9, 0.9, 0.0, 0.0, 0.0, 0.0, 0.0, 0.9]), (2, [0.0] * 9)], "k int, v array<double>")
    assert [tuple(r) for r in V.tree_rows(df, "k", 3, "v", 0.5).orderBy("tree").collect()] == [(1, 1, 2, 0.5), (1, 2, 1, 0.25)]


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_threshold_is_the_lowest_with_a_median_of_nothing(spark, n):
    rng = np.random.default_rng(n)
    scores = {k: rng.random(rng.integers(0, 4)).tolist() for k in range(n)}
    want = next((t for t in L.THRESHOLDS if np.median([sum(x >= t for x in own) for own in scores.values()]) == 0), L.STRICTEST)
    scored = spark.createDataFrame([(k, x) for k, own in scores.items() for x in own], "k int, score double")
    images = spark.createDataFrame([(k,) for k in scores], "k int")
    assert L.select_threshold(scored, images, "k", "score").first()["threshold"] == want
    assert L.select_threshold(scored, images.limit(0), "k", "score").first()["threshold"] == L.FALLBACK_THRESHOLD


def test_logistic_calibration_is_the_likeliest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(1.2, 0.8, 300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(1.9 * x - 2.4)))).astype(int)
    theta, design = np.zeros(2), np.column_stack([x, np.ones(300)])
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-design @ theta))
        theta += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "score double, label int")
    assert M.platt(df, "score", "label") == pytest.approx(theta.tolist(), abs=1e-6)


def test_isotonic_calibration_pools_neighbours_and_is_clipped(spark):
    rng = np.random.default_rng(6)
    x = np.sort(rng.random(80))
    y = np.where(x > 0.5, 1.3, -0.2) + rng.normal(0, 0.3, 80)
    blocks = []
    for value in y:  # neighbours that fall are pooled
        blocks.append([value, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    want = np.clip(np.repeat([b[0] for b in blocks], [b[1] for b in blocks]), 0, 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "score double, label double")
    out = M.isotonic_apply(M.isotonic(df, "score", "label"), df.unionByName(spark.createDataFrame([(9.0, 0.0), (-9.0, 0.0)], df.schema)), "score").orderBy("score").collect()
    assert [r["probability"] for r in out[1:-1]] == pytest.approx(want.tolist()) and (out[0]["probability"], out[-1]["probability"]) == (want[0], want[-1])
    assert out[0].asDict().keys() == {"score", "label", "probability"} and want.min() == 0 and want.max() == 1
    assert not math.isnan(sum(r["probability"] for r in out))
