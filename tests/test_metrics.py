"""Metrics against published values and on edge cases."""

import math

import pytest

from gradework.operators import metrics as M

#: Rows are the truth 0-4: a published confusion matrix and its kappa (fixed values).
PUBLISHED = [[37, 18, 9, 12, 2], [22, 32, 12, 14, 3], [8, 24, 10, 18, 15], [1, 4, 6, 30, 42], [3, 12, 15, 27, 21]]
KAPPA = 0.5234815278647464


@pytest.fixture(scope="module")
def graded(spark):
    rows = [(t, p) for t, line in enumerate(PUBLISHED) for p, n in enumerate(line) for _ in range(n)]
    return spark.createDataFrame(rows, "truth int, predicted int")


def test_published_kappa(graded):
    row = M.kappa(graded, "truth", "predicted").first()
    assert row["n"] == 397 and math.isclose(row["kappa"], KAPPA, rel_tol=1e-12)


def test_published_confusion(graded):
    cells = {(r["truth"], r["predicted"]): r["n"] for r in M.confusion(graded, "truth", "predicted").collect()}
    assert all(cells[t, p] == n for t, line in enumerate(PUBLISHED) for p, n in enumerate(line))


def test_kappa_undefined_and_perfect(spark):
    same = spark.createDataFrame([(2, 2)] * 3, "truth int, predicted int")
    assert M.kappa(same, "truth", "predicted").first()["kappa"] is None
    perfect = spark.createDataFrame([(k, k) for k in range(5)], "truth int, predicted int")
    assert M.kappa(perfect, "truth", "predicted").first()["kappa"] == 1.0


def test_auc_ties_one_class_and_monotone_maps(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "label int, score double")
    assert M.auc(df, "label", "score").first()["auc"] == pytest.approx(0.625)
    assert M.auc(df.selectExpr("label", "exp(score * 3) as score"), "label", "score").first()["auc"] == pytest.approx(0.625)
    assert M.auc(df.filter("label = 1"), "label", "score").first()["auc"] is None


def test_auc_without_groups_equals_one_group(spark):
    df = spark.range(5000).selectExpr("cast(id * 7919 % 3 = 0 as int) as label", "cast(id * 31 % 997 as double) as score", "'a' as g")
    assert M.auc(df, "label", "score").first()["auc"] == pytest.approx(M.auc(df, "label", "score", ["g"]).first()["auc"])


def test_reliability_edges(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 1.0)], "label int, p double")
    cells = {r["bin"]: r["n"] for r in M.reliability(df, "label", "p").collect()}
    assert (cells[0], cells[1], cells[9], sum(cells.values())) == (1, 1, 1, 3)


def test_operating_point_not_reached(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.8)], "label int, score double")
    row = M.operating_point(df, "label", "score").first()
    assert (row["threshold"], row["sensitivity"], row["reached"]) == (0.2, 1.0, True)
    assert M.operating_point(df.filter("label = 0"), "label", "score").first()["threshold"] is None


def test_strata_of_nine_and_ten_rows(spark):
    rows = [("a", i % 5, i % 5) for i in range(10)] + [("b", i % 5, i % 5) for i in range(9)]
    df = spark.createDataFrame(rows, "s string, truth int, predicted int")
    row = M.within_strata(lambda d, by: M.kappa(d, "truth", "predicted", by), df, "s", "kappa").first()
    assert (row["mean"], row["strata"], row["skipped"]) == (1.0, 1, 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "truth int, predicted int, label int, score double")
    assert M.kappa(none, "truth", "predicted").first()["kappa"] is None
    assert M.auc(none, "label", "score").first()["auc"] is None
    assert M.confusion(none, "truth", "predicted").count() == 0
