"""Gates, joins, rasters, models, sources and streams on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradework.functions.coerce import to_number
from gradework.operators import gates, grading, kernels, lesion, raster, relational, sampling
from gradework.sources import tables
from gradework.streaming import resume


def test_coercion(spark):
    texts = ["", " pass ", "Borderline", "FAIL", "nan", "inf", "abc", "1e3", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(to_number(F.col("t"))).collect()]
    assert got == [0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1000.0, 0.0]


def test_cut_on_the_point_is_below(spark):
    cuts = F.array(F.lit(1.0), F.lit(2.0))
    got = [r[0] for r in spark.createDataFrame([(1.0,), (1.5,), (2.5,)], "s double").select(gates.cut_grade(F.col("s"), cuts)).collect()]
    assert got == [0, 1, 2]


def test_zero_radius_fails(spark):
    row = spark.range(1).select(gates.area_ratio_gate(F.lit(0.0), F.lit(0.0)), gates.area_ratio_gate(F.lit(1.0), F.lit(1.0))).first()
    assert tuple(row) == ("fail", "pass")


def test_lookup_falls_back(spark):
    known = spark.createDataFrame([("a", 1.0), ("pooled", 9.0)], "k string, v double")
    got = {r["k"]: r["v"] for r in relational.lookup(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), known, "k", ["v"], "pooled").collect()}
    assert got == {"a": 1.0, "b": 9.0, None: 9.0}
    none = relational.lookup(spark.createDataFrame([("a",)], "k string"), known.limit(0), "k", ["v"], "pooled", {"v": 3.0})
    assert none.first()["v"] == 3.0


def test_merge_keeps_the_row_count(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    right = spark.createDataFrame([(1, "new", 5), (1, "newer", 6)], "k int, v string, w int")
    got = {r["k"]: (r["v"], r["w"]) for r in relational.merge(left, right, "k", F.col("w").desc()).collect()}
    assert got == {1: ("newer", 6), 2: (None, None)}


def test_draws_of_few_or_no_rows(spark):
    few = spark.range(4).selectExpr("id", "'g' as g", "cast(id as double) as v")
    assert sampling.banded_draw(few, ["g"], "v", "id", 10).count() == 4
    assert sampling.banded_draw(few.limit(0), ["g"], "v", "id", 10).count() == 0


def test_draw_does_not_depend_on_partitions(spark):
    rows = spark.range(200).selectExpr("id", "id % 3 as g", "cast(id * 37 % 101 as double) as v")
    one = {tuple(r) for r in sampling.banded_draw(rows.coalesce(1), ["g"], "v", "id", 20).collect()}
    many = {tuple(r) for r in sampling.banded_draw(rows.repartition(7), ["g"], "v", "id", 20).collect()}
    assert one == many and len(one) == 60


def image(spark, array):
    h, w = array.shape
    return spark.createDataFrame([(1, y, x, float(array[y, x])) for y in range(h) for x in range(w)], "k int, y int, x int, v double")


def test_blur_lowers_focus(spark):
    rng = np.random.default_rng(0)
    sharp = rng.random((16, 16))
    focus = [raster.brenner(image(spark, kernels.gaussian(sharp, s) if s else sharp), "k").first()["brenner"] for s in (0, 0.5, 1.0, 2.0)]
    assert focus == sorted(focus, reverse=True)


def test_black_image_has_no_view(spark):
    row = raster.view_mask(image(spark, np.zeros((4, 4))).withColumn("lit", F.col("v") > 0), "k").first()
    assert (row["pixels"], row["rh"], row["rv"]) == (0, 0.0, 0.0)


def test_labels_by_sides_and_corners():
    mask = np.array([[1, 0, 1], [0, 1, 0], [1, 0, 1]], bool)
    assert kernels.label(mask, 4)[1] == 5 and kernels.label(mask, 8)[1] == 1
    spiral = np.ones((30, 30), bool)
    spiral[1:29:2, :-1] = False
    assert kernels.label(spiral, 4)[1] == 1
    assert kernels.label(np.zeros((3, 3), bool))[1] == 0


def test_circle_fit_finds_a_circle(spark):
    t = np.linspace(0, 6, 40)
    rows = [(1, float(3 + 2 * np.cos(a)), float(-1 + 2 * np.sin(a))) for a in t]
    row = raster.circle(spark.createDataFrame(rows, "k int, x double, y double"), "k").first()
    assert (row["cx"], row["cy"], row["r"]) == pytest.approx((3, -1, 2))


def test_small_spots_are_closed():
    dark = np.ones((21, 21))
    dark[10, 10] = 0
    gap = kernels.least_line_closing(dark, 5) - dark
    assert gap[10, 10] == 1 and gap.sum() == 1


def test_resample_keeps_a_disc():
    y, x = np.indices((61, 61))
    disc = ((y - 30) ** 2 + (x - 30) ** 2 <= 20**2).astype(float)
    out = kernels.resampled(disc, 30, 30, 20, 40, 101)
    assert out[50, 50] == 1 and out[50, 5] == 0 and abs(out.sum() / (np.pi * 40**2) - 1) < 0.05
    assert kernels.resampled(disc, 0, 0, 0, 40, 11).sum() == 0


def test_no_candidates_is_the_longest_distance(spark):
    images = spark.createDataFrame([(1, 1.0, 1.0, 3.0, 1.0, 0, 1)], "k int, od_x double, od_y double, fovea_x double, fovea_y double, venous_beading_quadrants int, nv_irma_quadrants int")
    kept = spark.createDataFrame([], "k int, lesion string, cx double, cy double, area double")
    row = lesion.image_rows(images, kept, "k", 10.0).first()
    assert row["exudate_fovea_min_dist_dd"] == pytest.approx(2 * 436 * 2**0.5 / 124)
    assert (row["haem_count"], row["severe_npdr_flag"], row["rule421_haem"]) == (0, 1, 0)


def test_threshold_without_images(spark):
    scored = spark.createDataFrame([], "k int, score double")
    none = spark.createDataFrame([], "k int")
    assert lesion.select_threshold(scored, none, "k", "score").first()[0] == 0.5
    assert lesion.select_threshold(scored, spark.createDataFrame([(1,)], "k int"), "k", "score").first()[0] == 0.05


def test_blocks():
    assert len(lesion.inputs_through("6g_quadrants_421")) == 38 and len(lesion.inputs_through("6a_measured_core")) == 12
    with pytest.raises(KeyError):
        lesion.inputs_through("7")
    assert lesion.schema_gaps(["a", "b"], ["a", "c"]) == (["c"], ["b"])


def test_constant_feature_scales_by_one(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert grading.scale_fit(df, ["x"]) == {"x": (2.0, 1.0)}


def test_platt_recovers_its_parameters(spark):
    rows = spark.range(4000).selectExpr("cast(id % 80 as double) / 10 - 4 as s", "id")
    rows = rows.selectExpr("s", "cast(xxhash64(id) % 100000 / 100000.0 + 1 as double) / 2 < 1 / (1 + exp(-(1.5 * s - 0.5))) as y").selectExpr("s", "cast(y as int) as y")
    slope, intercept = grading.platt(rows, "s", "y")
    assert slope == pytest.approx(1.5, abs=0.2) and intercept == pytest.approx(-0.5, abs=0.2)


def test_cuts_separate_grades(spark):
    rows = spark.range(500).selectExpr("cast(id % 5 as int) as g", "cast(id % 5 + (id * 17 % 10) / 20.0 as double) as s")
    cuts = grading.fit_cutpoints(rows, "s", "g")
    graded = rows.withColumn("p", gates.cut_grade(F.col("s"), F.array(*map(F.lit, cuts))))
    assert len(cuts) == 4 and graded.filter("p <> g").count() == 0


def test_too_small_for_a_forest(spark):
    assert grading.forest(spark.createDataFrame([(1.0, 0.0)], "x double, y double"), ["x"], "y") is None


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1e3", 2), ("b", None)], tables.LABELS)
    tables.write_csv(df, f"{tmp_path}/l", ["id_code", "diagnosis"])
    assert {tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/l", tables.LABELS).collect()} == {("1e3", 2), ("b", None)}
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert [r[0] for r in tables.read_ids(spark, f"{tmp_path}/ids.txt").collect()] == ["a", "b"]
    tables.write_csv(df.limit(0), f"{tmp_path}/e", ["id_code", "diagnosis"])
    with pytest.raises(ValueError):
        tables.read_csv(spark, f"{tmp_path}/e", tables.LABELS, required=True)


def test_appends_resume_and_refuse_other_columns(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.append_pending(spark.createDataFrame([(1, "a")], "k int, v string"), path, "k")
    tables.append_pending(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), path, "k")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    with pytest.raises(ValueError):
        tables.append_pending(spark.createDataFrame([(3,)], "k int"), path, "k")


def test_stream_does_each_file_once(spark, tmp_path):
    source, sink, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    rows = spark.range(5).selectExpr("id", "id * 2 as v")
    rows.write.parquet(source)
    step = lambda df: df.filter("id > 0")
    assert resume.run_available(spark, source, rows.schema, step, sink, mark) == 5
    spark.range(5, 7).selectExpr("id", "id * 2 as v").write.mode("append").parquet(source)
    assert resume.run_available(spark, source, rows.schema, step, sink, mark) == 2
    assert spark.read.parquet(sink).count() == 6


def test_final_state_stays(spark):
    rows = [(1, 1, "draft"), (1, 2, "completed"), (1, 3, "draft"), (2, 1, "draft")]
    got = {tuple(r) for r in resume.latest_state(spark.createDataFrame(rows, "k int, o int, s string"), "k", "o", "s", "completed").collect()}
    assert got == {(1, "completed"), (2, "draft")}


def test_disc_fovea_and_candidates(spark):
    from gradework.operators import anatomy

    y, x = np.indices((64, 64))
    scene = np.full((64, 64), 100.0)
    scene[(y - 32) ** 2 + (x - 14) ** 2 <= 9] = 220  # the disc
    scene[(y - 32) ** 2 + (x - 33) ** 2 <= 20] = 40  # the macula
    scene[10:12, 40:42] = 20
    px = image(spark, scene)
    disc = anatomy.optic_disc(anatomy.disc_candidates(px, "k", 32.0), "k")
    row = disc.first()
    assert abs(row["cy"] - 32) <= 2 and abs(row["cx"] - 14) <= 2 and row["confirmed"]
    spot = anatomy.fovea(px, disc, "k", 8.0, (32.0, 32.0), 2).first()
    assert spot["found"] and abs(spot["y"] - 32) < 4 and abs(spot["x"] - 33) < 5
    spots = anatomy.lesion_candidates(px, "k", 15, 99.0, 3, 30).collect()
    assert any(abs(r["cy"] - 10.5) < 1 and abs(r["cx"] - 40.5) < 1 and r["area"] == 4 for r in spots)


def test_enhancement_rules(spark):
    from gradework.operators import anatomy

    rows = [(1, s, c, sat, n, sev) for s, c, sat, n, sev in ((0, 10.0, 0.0, 5.0, 0.2), (1, 9.0, 0.0, 5.0, 0.2), (2, 12.0, 0.1, 5.0, 0.0), (3, 12.0, 0.01, 7.0, 0.0), (4, 11.0, 0.0, 5.0, 0.0))]
    rows += [(2, s, 10.0 - s, 0.0, 5.0, 0.95) for s in range(5)]
    df = spark.createDataFrame(rows, "k int, step int, contrast double, saturation double, noise double, severe double")
    got = {r["k"]: (r["status"], r["flat_field"], r["clip"]) for r in anatomy.enhancement_choice(df, "k").collect()}
    assert got == {1: ("pass", True, 1.5), 2: ("fail", False, None)}


def test_entry_lives_without_the_training_data_part(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/gradework", tmp_path / "gradework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    done = run()
    assert done.returncode == 0, done.stderr
    if os.path.exists(f"{root}/corpus_pipeline.py"):
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
        done = run()
        assert done.returncode == 0, done.stderr
