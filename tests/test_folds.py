"""Fold-wise models see no row that they score; versions, bundles and streams survive failures and restarts."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradework.operators import folds as V
from gradework.operators import grading as M
from gradework.operators import lesion as L
from gradework.operators import perceptron as N
from gradework.sources import tables
from gradework.streaming import resume

DATASET = "id_code string, split string, cv_fold string, grade int, stage1_verdict string, enhancement_applied string, a string, b double"


@pytest.fixture(scope="module")
def dataset(spark):
    rows = [("i1", "dev", "0", 0, " Borderline ", "2", "pass", 1.0), ("i2", "dev", "1", 3, "pass", "0", "2.5", 2.0), ("i3", "dev", "1", 4, None, None, "", 3.0), ("i4", "test", "", 0, "BORDERLINE", "nan", "fail", 4.0), ("i5", "dev", None, 1, "fail", "x", "7", None)]
    return spark.createDataFrame(rows, DATASET)


def ids(df):
    return sorted(r["id_code"] for r in df.collect())


def test_rows_of_folds(dataset):
    assert ids(V.dev(dataset)) == ["i1", "i2", "i3", "i5"] and ids(V.test(dataset)) == ["i4"]
    assert ids(V.in_fold(dataset, "1")) == ["i2", "i3"] and ids(V.in_fold(dataset, "")) == ["i4"]
    assert ids(V.not_in_fold(dataset, "1")) == ["i1", "i5"] and V.folds(dataset) == ["0", "1"]


def test_matrix_is_ordered_coerced_and_overlaid(spark, dataset):
    over = spark.createDataFrame([("i2", 9.0), ("i4", None)], "id_code string, b double")
    got = {r["id_code"]: tuple(r)[1:] for r in V.matrix(dataset, ["b", "a", "absent"], over).collect()}
    plain = {r["id_code"]: tuple(r)[1:] for r in V.matrix(dataset, ["a", "b"]).collect()}
    assert V.matrix(dataset, ["b", "a", "absent"]).columns == ["id_code", "b", "a", "absent"]
    assert got["i2"][:2] == (9.0, 2.5) and got["i1"][0] == 1.0 and got["i4"][0] != 4.0  # a row of the overlay counts, its nulls too
    assert plain["i1"][0] != plain["i4"][0] and plain["i2"] == (2.5, 2.0)


def test_confidence_flags(dataset):
    borderline, enhanced = V.confidence_flags(dataset)
    assert {r["id_code"]: (r["x"], r["y"]) for r in dataset.select("id_code", borderline.alias("x"), enhanced.alias("y")).collect()} == {
        "i1": (True, True), "i2": (False, False), "i3": (False, False), "i4": (True, False), "i5": (False, False),
    }


def lesions(spark, per_image=12, images=60, seed=1):
    """Candidates whose one feature tells their image and nothing else; grades are random."""
    rng = random.Random(seed)
    grades = {f"i{k}": rng.choice((0, 3)) for k in range(images)}
    rows = [(i, "ma", k + rng.random() * 0.01, rng.random(), 1.0, 1.0, 5.0) for k, i in enumerate(grades) for _ in range(per_image)]
    table = [(i, g, "test" if k % 6 == 5 else "dev", "" if k % 6 == 5 else str(k % 3), 1.0, 1.0, 5.0, 1.0, 0, 0) for k, (i, g) in enumerate(grades.items())]
    return (
        spark.createDataFrame(rows, "id_code string, lesion string, f double, noise double, cx double, cy double, area double"),
        spark.createDataFrame(table, "id_code string, grade int, split string, cv_fold string, od_x double, od_y double, fovea_x double, fovea_y double, venous_beading_quadrants int, nv_irma_quadrants int"),
    )


def test_no_candidate_is_scored_by_a_model_that_saw_it(spark, monkeypatch):
    candidates, images = lesions(spark)
    seen = []
    fit = M.forest

    def watched(train, features, label, trees=200, **more):
        seen.append({r["id_code"] for r in train.select("id_code").distinct().collect()})
        return fit(train, features, label, trees=trees, **more)

    monkeypatch.setattr(M, "forest", watched)
    places = [*V.folds(images), V.TEST]
    fitted = {k: V.fit_fold(candidates, images, ["f", "noise"], k, ("ma",), trees=10) for k in places}
    held = {k: {r["id_code"] for r in (V.test(images) if k == V.TEST else V.in_fold(V.dev(images), k)).collect()} for k in places}
    every = {r["id_code"] for r in V.dev(images).collect()}
    for k, own in zip(places, seen):
        assert own == every - held[k]  # all others, and nothing of its own
    scored = V.scored_out_of_fold(candidates, images, ["f", "noise"], fitted)
    rows = scored.join(images.select("id_code", "grade"), "id_code").collect()
    assert len(rows) == candidates.count() and {r["fold"] for r in rows} == set(places)
    # A model of the own fold would know its images by heart; one of other folds cannot tell.
    right = np.mean([(r["score"] >= 0.5) == (r["grade"] == 3) for r in rows])
    inside = M.forest_score(fitted["0"]["ma"].model, candidates.join(V.not_in_fold(images, "0").select("id_code", "grade"), "id_code"), ["f", "noise"]).collect()
    assert right < 0.65 < 0.75 < np.mean([(r["score"] >= 0.5) == (r["grade"] == 3) for r in inside])


def test_too_few_candidates_fall_back(spark):
    candidates, images = lesions(spark, per_image=1, images=18)
    fitted = V.fit_fold(candidates, images, ["f", "noise"], "0", ("ma", "haem"))
    assert all(c.model is None and c.threshold == L.FALLBACK_THRESHOLD for c in fitted.values())
    scored = V.scored_out_of_fold(candidates, images, ["f", "noise"], {"0": fitted})
    assert {r["fold"] for r in scored.collect()} == {"0"} and all(r["score"] == 0 and not r["kept"] for r in scored.collect())


def test_recomputed_columns_only(spark):
    _, images = lesions(spark, images=3)
    dataset = images.withColumns({c: F.lit(77) for c in V.DEPENDENT}).withColumn("vessel_length", F.lit(5.5))
    scored = spark.createDataFrame([("i0", "ma", 1.0, 1.0, 4.0, True), ("i0", "hard_exudate", 5.0, 1.0, 4.0, True), ("i1", "ma", 1.0, 1.0, 4.0, False)], "id_code string, lesion string, cx double, cy double, area double, kept boolean")
    got = {r["id_code"]: r for r in V.recomputed(dataset, scored, 200.0).collect()}
    assert (got["i0"]["ma_count"], got["i0"]["hard_exudate_count"], got["i0"]["dme_flag"], got["i0"]["hard_exudate_area_pct"]) == (1, 1, 1, 2.0)
    assert got["i1"]["ma_count"] == 0 and got["i2"]["ma_count"] == 77 and all(r["vessel_length"] == 5.5 for r in got.values())
    assert V.recomputed(dataset, scored, 200.0).columns == dataset.columns


# ---- perceptron


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(20, 3)), rng.normal(size=20), rng.random(20)
    theta = N.initial(3, (5, 4), 1) + rng.normal(0, 0.05, len(N.initial(3, (5, 4), 1)))
    slope, _ = N.gradient(theta, x, y, w, (5, 4))
    for k in range(0, len(theta), 5):
        step = np.zeros(len(theta))
        step[k] = 1e-6
        numeric = (N.gradient(theta + step, x, y, w, (5, 4))[1] - N.gradient(theta - step, x, y, w, (5, 4))[1]) / 2e-6
        assert slope[k] == pytest.approx(numeric, abs=1e-5)


def bent(spark, n=1200):
    rng = np.random.default_rng(8)
    a, b = rng.uniform(-2, 2, n), rng.uniform(-2, 2, n)
    grade = np.clip(np.rint(2 + 1.6 * np.sin(2 * a) * np.sign(b)), 0, 4).astype(int)
    return spark.createDataFrame([(int(k), float(a[k]), float(b[k]), int(grade[k]), str(k % 3)) for k in range(n)], "id long, a double, b double, grade int, fold string")


def test_perceptron_beats_the_linear_score_on_a_bent_target(spark):
    df = bent(spark)
    out = N.cross_validated(df, ["a", "b"], "grade", "fold", ["id", "grade"], hidden=(16, 8), steps=120, rate=0.03, penalty=1e-4).collect()
    assert len(out) == 1200
    error = np.mean([(r["grade_score"] - r["grade"]) ** 2 for r in out])
    linear = LinearRegression(featuresCol="_features", labelCol="grade").fit(M.assembled(df, ["a", "b"])).summary.meanSquaredError
    assert error < 0.5 * linear


def test_a_model_takes_nothing_from_its_own_fold(spark):
    df = bent(spark, 300)
    wild = df.withColumn("a", F.when(F.col("fold") == "1", F.col("a") * 1000).otherwise(F.col("a"))).withColumn("grade", F.when(F.col("fold") == "1", 0).otherwise(F.col("grade")))
    own = [N.trainings(d.select("fold", F.array("a", "b").alias("x"), F.col("grade").cast("double").alias("y")), 2)["1"] for d in (df, wild)]
    assert np.allclose(own[0].mean, own[1].mean) and np.allclose(own[0].spread, own[1].spread) and own[0].weights == own[1].weights
    given = [d.select("fold", F.array("a", "b").alias("x"), F.col("grade").cast("double").alias("y")) for d in (df, wild)]
    theta = [N.fit_folds(g, 2, N.trainings(g, 2), (4,), 3) for g in given]
    assert np.allclose(theta[0]["1"], theta[1]["1"]) and not np.allclose(theta[0]["0"], theta[1]["0"])


def test_perceptron_with_missing_values(spark):
    rows = [(k, None if k % 5 == 0 else float(k % 7), 1.0, None if k % 11 == 0 else k % 5, None if k == 3 else str(k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, same double, grade int, fold string")
    out = N.cross_validated(df, ["a", "same"], "grade", "fold", ["id"], hidden=(3,), steps=4).collect()
    assert len(out) == 59 and all(math.isfinite(r["grade_score"]) for r in out)
    with pytest.raises(ValueError):
        N.cross_validated(df.filter("fold = '1'"), ["a"], "grade", "fold", ["id"])


# ---- versions and bundles


def test_a_failed_write_leaves_the_last_version(spark):
    path = tables.scratch(spark, "v")
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, path)
    tables.write_version(spark.range(5), path)
    with pytest.raises(Exception, match="broken"):
        tables.write_version(spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id")), path)
    assert tables.versions(spark, path) == [1] and tables.read_version(spark, path).count() == 5
    assert tables.write_version(tables.read_version(spark, path).filter("id > 1"), path) == 2
    assert (tables.read_version(spark, path).count(), tables.read_version(spark, path, 1).count()) == (3, 5)


def test_bundles_come_back(spark):
    path = tables.scratch(spark, "b")
    df = spark.createDataFrame([(float(k), 2.0 * k + 1) for k in range(20)], "a double, grade double")
    model = LinearRegression(featuresCol="_features", labelCol="grade").fit(M.assembled(df, ["a"]))
    assert tables.save_bundle(spark, path, {"scorer": model}, {"cuts": [0.5, 1.5]}) == 1
    models, settings = tables.load_bundle(spark, path)
    assert settings == {"cuts": [0.5, 1.5]} and models["scorer"].coefficients[0] == pytest.approx(2.0)


# ---- streams

ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])


def test_a_stream_goes_on_where_it_stopped(spark):
    folder = tables.scratch(spark, "s")
    source, sink, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/c"
    run = lambda: resume.resume(spark, source, ROW, lambda rows: rows.filter("v >= 0"), sink, checkpoint, "k", files_at_once=1)
    part = lambda rows: spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(source)
    part([(1, 10), (2, 20), (2, 5), (None, 1)])
    assert sorted(map(str, run().collect())) == sorted(map(str, run().collect())) and run().count() == 3
    part([(2, 99), (3, 30), (4, -1), (None, 1)])
    got = sorted((r["k"] or 0, r["v"]) for r in run().collect())
    assert got == [(0, 1), (0, 1), (1, 10), (2, 5), (3, 30)]


def test_a_batch_done_again_adds_nothing(spark):
    sink = tables.scratch(spark, "again")
    add = resume.append_by_key(sink, "k")
    first, second = (spark.createDataFrame(rows, ROW) for rows in ([(1, 1), (2, 2)], [(2, 7), (3, 3)]))
    add(first, 0)
    add(second, 1)
    add(second, 1)  # as after a failure between the write and the checkpoint
    assert sorted(tuple(r) for r in spark.read.parquet(sink).select("k", "v").collect()) == [(1, 1), (2, 2), (3, 3)]
