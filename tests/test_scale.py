"""What queries must not do if they are to grow with their tables: move pixels, make images twice, hold a group in one task."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gradework.operators import anatomy
from gradework.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def scenes(n=3, size=32):
    made = np.random.default_rng(5)
    y, x = np.indices((size, size))
    return [np.clip(128 + 60 * np.sin(x / made.uniform(2, 6)) + 50 * np.cos(y / made.uniform(2, 6)) + made.normal(0, 8, (size, size)), 0, 255) for _ in range(n)]


def both_forms(spark, images):
    arrays = spark.createDataFrame([(k, a.ravel().tolist()) for k, a in enumerate(images)], "k long, v array<double>")
    pixels = spark.createDataFrame([(k, y, x, float(a[y, x])) for k, a in enumerate(images) for y in range(a.shape[0]) for x in range(a.shape[1])], "k long, y int, x int, v double")
    return arrays, pixels


def same(one, other):
    a, b = (sorted(map(tuple, df.collect())) for df in (one, other))
    assert len(a) == len(b) > 0
    for p, q in zip(a, b):
        assert p == pytest.approx(q, abs=1e-6)


def test_enhancement_is_tried_once_an_image(spark, sf_dir):
    text = plan(catalog.QUERIES["enhancement_choice"](spark, sf_dir))
    assert text.count("MapInArrow") == 2 and "FlatMapGroupsInPandas" not in text and "Join" not in text  # drawn, tried
    arrays, pixels = both_forms(spark, scenes())
    same(anatomy.enhancement_attempt_rows(arrays, "k", 32), anatomy.enhancement_attempts(pixels, "k"))


def test_landmarks_join_no_pixels(spark, sf_dir):
    text = plan(catalog.QUERIES["landmarks"](spark, sf_dir))
    assert "Join" not in text and "Broadcast" not in text and "FlatMapGroupsInPandas" not in text
    arrays, pixels = both_forms(spark, scenes())
    discs = anatomy.optic_disc(anatomy.disc_candidates(pixels, "k", 16.0), "k")
    rows = discs.join(anatomy.fovea(pixels, discs, "k", 4.0, (16.0, 16.0), 2), "k")
    same(anatomy.landmark_rows(arrays, "k", 32, 16.0, 4.0, (16.0, 16.0), 2), rows)


def test_landmarks_without_a_point_of_the_fan(spark):
    """A fan that begins outside the image takes the expected place and tells of no darkness."""
    flat = np.zeros((8, 8))
    flat[0, 0] = 200.0
    arrays, pixels = both_forms(spark, [flat])
    discs = anatomy.optic_disc(anatomy.disc_candidates(pixels, "k", 4.0), "k")
    rows = discs.join(anatomy.fovea(pixels, discs, "k", 20.0, (0.0, 8.0), 2), "k")
    same(anatomy.landmark_rows(arrays, "k", 8, 4.0, 20.0, (0.0, 8.0), 2), rows)


def test_candidates_stay_with_their_image(spark, sf_dir):
    assert "FlatMapGroupsInPandas" not in plan(catalog.QUERIES["lesion_candidates"](spark, sf_dir))
    arrays, pixels = both_forms(spark, scenes())
    same(anatomy.lesion_candidate_rows(arrays, "k", 32, 15, 96.0, 3, 900), anatomy.lesion_candidates(pixels, "k", 15, 96.0, 3, 900))


def test_images_are_drawn_and_measured_without_a_join(spark, sf_dir):
    for name, kernels in (("focus_rows", 2), ("stage1_rows", 2), ("vessel_map", 2), ("lesion_spots", 2), ("candidate_features", 2), ("image_features", 2), ("view_detection", 2), ("stage2_rows", 2)):
        text = plan(catalog.QUERIES[name](spark, sf_dir))
        assert text.count("MapInArrow") == kernels, name  # drawn, measured; no picture by lambdas over pixels
        assert "transform(sequence" not in text and "lambdafunction" not in text, name


def test_candidates_about_found_landmarks(spark, sf_dir):
    from gradework.operators import landmarks, traits
    from gradework.plans import vision

    images = vision.eyes(spark, sf_dir).select("vec_id", "red", "green", "blue").filter("vec_id % 50 = 0")
    features = landmarks.image_features(images, "vec_id", vision.SIZE, vision.SMALL)
    joined = images.join(features.select("vec_id", "od_x", "od_y", "od_radius", "fovea_x", "fovea_y"), "vec_id")
    found = traits.located_candidate_rows(images, "vec_id", vision.SIZE, vision.SMALL)
    assert "Join" not in plan(found)
    one, other = found.collect(), traits.candidate_rows(joined, "vec_id", vision.SIZE, vision.SMALL).collect()
    assert sorted(map(str, one)) == sorted(map(str, other)) and one


def test_grown_masks():
    from gradework.operators import filters as P

    made = np.random.default_rng(3)
    for mask in (made.random((40, 30)) > 0.97, np.pad([[True]], ((2, 30), (25, 1))), np.zeros((9, 9), dtype=bool), made.random((20, 20)) > 0.3):
        for radius in (1, 4, 12):
            assert np.array_equal(P.grown(mask, radius), P.extreme(mask, P.ellipse(2 * radius + 1), True))


def test_drawing_leaves_out_rows_without_numbers(spark):
    from gradework.operators import images as I

    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [3.0, 4.0])]
    got = I.drawn(spark.createDataFrame(rows, "k int, v array<float>"), ["k"], "v", ["a", "b"], lambda v: (v, 2 * v)).collect()
    assert {r["k"]: (r["a"], r["b"]) for r in got} == {1: ([1, 2], [2, 4]), 2: (None, None), 3: (None, None), 4: (None, None), 5: ([3, 4], [6, 8])}


def windows(df) -> list[str]:
    """The windows of a query, without those over sums of ranges, which are few rows."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line for line in lines if "Window [" in line and "sum(_t" not in line]


def test_rank_correlation_holds_no_group_in_a_task(spark):
    from gradework.operators import metrics

    made = np.random.default_rng(2)
    rows = [(g, float(made.integers(0, 9)), float(made.normal())) for g in ("a", "b", None) for _ in range(70)]
    rows += [("a", None, 1.0), ("a", None, 2.0), ("b", 3.0, None), ("b", math.nan, 0.5)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = metrics.spearman(df, "x", "y", ["g"])
    rank = lambda c: F.rank().over(Window.partitionBy("g").orderBy(c)) + (F.count("*").over(Window.partitionBy("g", c)) - 1) / 2
    want = df.withColumns({"a": rank("x"), "b": rank("y")}).groupBy("g").agg(F.count("*").alias("n"), F.corr("a", "b").alias("rho"))
    same(got.orderBy("g").select("n", "rho"), want.orderBy("g").select("n", "rho"))
    assert all("_range" in w for w in windows(got)) and len(windows(got)) > 0


def test_bands_hold_no_group_in_a_task(spark):
    from gradework.operators import sampling

    made = np.random.default_rng(4)
    rows = [(g, i, float(made.integers(0, 40)) if i % 11 else None) for g, n in (("a", 203), ("b", 7), (None, 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = sampling.bands(df, ["g"], "v", "k")
    assert got.columns == ["g", "k", "v", "band"]
    group = Window.partitionBy("g")
    i = F.row_number().over(group.orderBy("v", "k")) - 1
    want = df.withColumn("band", F.least(F.floor(i * 10 / F.count("*").over(group)), F.lit(9)).cast("int"))
    key = lambda r: tuple(map(str, r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert all("_range" in w for w in windows(got)) and windows(got)
    drawn = sampling.banded_draw(df, ["g"], "v", "k", 5)
    assert "WindowGroupLimit" in plan(drawn) and drawn.filter("g = 'a'").count() == 5


def test_matched_filters_shuffle_no_pixels(spark, sf_dir):
    from gradework.operators import raster
    from gradework.plans import imaging, inputs

    text = plan(catalog.QUERIES["matched_filter_grid"](spark, sf_dir))
    assert "Join" not in text and text.count("MapInArrow") == 1
    some = inputs.table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    pixels = raster.pixels(some, "vec_id", "embedding", 8)
    one = raster.strongest_rows(some, "vec_id", 8, "embedding", imaging._FILTERS).select("vec_id", "y", "x", "v")
    same(one, raster.strongest(pixels, "vec_id", imaging._FILTERS).select("vec_id", "y", "x", "v"))


def test_candidates_meet_grades_once_a_fold(spark, monkeypatch):
    from gradework.operators import folds, grading

    seen = []
    fit = grading.forest
    monkeypatch.setattr(folds.M, "forest", lambda train, *a, **k: seen.append(plan(train)) or fit(train, *a, **k))
    images = spark.createDataFrame([(i, (0, 3, 2, 4)[i % 4], "dev", str(i // 4 % 2)) for i in range(80)], "id_code int, grade int, split string, cv_fold string")
    candidates = spark.createDataFrame([(i, ("ma", "haem")[j % 2], float(i % 4 + j / 10)) for i in range(80) for j in range(6)], "id_code int, lesion string, v double")
    fitted = folds.fit_fold(candidates, images, ["v"], "0", ("ma", "haem"), trees=3)
    assert all(c.model is not None for c in fitted.values()) and len(seen) == 2
    assert all("InMemoryTableScan" in text for text in seen)
