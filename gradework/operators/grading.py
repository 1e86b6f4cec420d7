"""Fold-wise models for grades: scaling, scoring, cut points, calibration, cross-validation.

What is fitted sees training rows only.  Cut points and operating points are found on counts, not rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import neighbours, percentiles
from .metrics import GRADES, kappa, within_strata

DEFAULT_CUTS = (0.5, 1.5, 2.5, 3.5)


def scale_fit(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """feature -> (mean, population deviation, 1 where it is 0), in one aggregation."""
    row = train.agg(*(f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(features) for f in (F.avg, F.stddev_pop))).first()
    out = {}
    for i, c in enumerate(features):
        mean, spread = row[f"avg_{i}"], row[f"stddev_pop_{i}"]
        out[c] = (mean or 0.0, spread if spread and spread > 1e-12 else 1.0)
    return out


def scaled(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features").transform(df)


def balanced(train: DataFrame, label: str) -> DataFrame:
    """``train`` with _weight: rows of all labels weigh the same in sum."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for k, n in sorted(counts.items()):
        weight = F.when(F.col(label) == k, total / (len(counts) * n)).otherwise(weight)
    return train.withColumn("_weight", weight)


def forest(train: DataFrame, features: list[str], label: str, trees: int = 200, min_rows: int = 30, min_minority: int = 10):
    """A class-balanced forest, or None where there are too few rows of either class."""
    counts = [r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()]
    if sum(counts) < min_rows or len(counts) < 2 or min(counts) < min_minority:
        return None
    model = RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="_weight", numTrees=trees, minInstancesPerNode=5, seed=0)
    return model.fit(assembled(balanced(train, label), features))


def forest_score(model, df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with score, the probability of label 1."""
    out = model.transform(assembled(df, features)).withColumn("score", vector_to_array("probability")[1])
    return out.select(*df.columns, "score")


def platt(train: DataFrame, score: str, label: str, penalty: float = 0.0) -> tuple[float, float]:
    """(slope, intercept) of the logistic calibration."""
    model = LogisticRegression(featuresCol="_features", labelCol=label, regParam=penalty, standardization=penalty == 0, tol=1e-10, maxIter=200).fit(assembled(train, [score]))
    return float(model.coefficients[0]), float(model.intercept)


def platt_apply(df: DataFrame, score: str, slope: float, intercept: float) -> DataFrame:
    return df.withColumn("probability", 1 / (1 + F.exp(-(F.col(score) * slope + intercept))))


def isotonic(train: DataFrame, score: str, label: str):
    """A monotone calibration for ``isotonic_apply``."""
    return IsotonicRegression(featuresCol=score, labelCol=label).fit(train.withColumns({score: F.col(score).cast("double"), label: F.col(label).cast("double")}))


def isotonic_apply(model, df: DataFrame, score: str) -> DataFrame:
    """``df`` with probability, inside [0, 1]; scores beyond the training range have the value at its end."""
    own = "_isotonic_score"
    fitted = model.copy().setFeaturesCol(own).setPredictionCol("_isotonic")
    out = fitted.transform(df.withColumn(own, F.col(score).cast("double")))
    return out.withColumn("probability", F.least(F.greatest("_isotonic", F.lit(0.0)), F.lit(1.0))).drop(own, "_isotonic")


def cut_candidates(df: DataFrame, score: str, most: int = 400) -> list[float]:
    """Middles between neighbouring distinct scores; of more than ``most``, so many even quantiles of the middles."""
    pairs = neighbours(df, score).persist()
    try:
        n = pairs.count()
        if n < 2:
            return [r[score] for r in pairs.collect()]
        middles = pairs.filter("next is not null").select(((F.col(score) + F.col("next")) / 2).alias("middle"))
        if n - 1 > most:
            middles = percentiles(middles, ["middle"], [k / (most - 1) for k in range(most)]).select(F.col("value").alias("middle"))
        return sorted(r["middle"] for r in middles.collect())
    finally:
        pairs.unpersist()


def fit_cutpoints(df: DataFrame, score: str, grade: str, classes: int = GRADES, candidates: int = 400, passes: int = 50) -> list[float]:
    """Cut points by coordinate ascent on quadratic kappa; a score on a cut point has the lower grade.

    The search starts from the quantiles of the scores at the shares of the grades, and moves one cut point at a time to the
    candidate, between its neighbours, of the largest kappa.  It reads grade counts between neighbouring candidates and
    starting points, so rows stay in Spark.  Without rows the cut points are ``DEFAULT_CUTS``.
    """
    rows = df.select(F.col(score).cast("double").alias("_s"), F.least(F.greatest(F.bround(grade), F.lit(0)), F.lit(classes - 1)).cast("int").alias("_g")).filter("_s is not null and _g is not null")
    shares = {r["_g"]: r["n"] for r in rows.groupBy("_g").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return list(DEFAULT_CUTS)
    total = sum(shares.values())
    upto = np.cumsum([shares.get(g, 0) for g in range(classes)])[:-1] / total
    first = {r["share"]: r["value"] for r in percentiles(rows, ["_s"], sorted(set(upto.tolist()))).collect()}
    cuts = sorted(first[x] for x in upto.tolist())
    places = cut_candidates(rows, "_s", candidates)
    edges = sorted(set(places) | set(cuts))
    interval = F.size(F.filter(F.array(*map(F.lit, edges)), lambda c: c < F.col("_s")))
    table = np.zeros((len(edges) + 1, classes))
    for r in rows.groupBy(interval.alias("i"), "_g").agg(F.count("*").alias("n")).collect():
        table[r["i"], r["_g"]] = r["n"]
    below = np.concatenate([np.zeros((1, classes)), np.cumsum(table, axis=0)])  # rows up to an edge, by grade
    at = {e: i + 1 for i, e in enumerate(edges)}
    distance = np.subtract.outer(np.arange(classes), np.arange(classes)) ** 2

    def quality(marks: list[float]) -> float:
        bounds = [0, *(at[m] for m in marks), len(edges) + 1]
        matrix = np.array([below[b] - below[a] for a, b in zip(bounds[:-1], bounds[1:])]).T
        expected = (distance * np.outer(matrix.sum(axis=1), matrix.sum(axis=0))).sum()
        return 1 - total * (distance * matrix).sum() / expected if expected else math.nan

    best = quality(cuts)
    for _ in range(passes):
        moved = False
        for k in range(len(cuts)):
            low, high = cuts[k - 1] if k else -math.inf, cuts[k + 1] if k + 1 < len(cuts) else math.inf
            for place in places:
                if low <= place <= high:
                    trial = [*cuts[:k], place, *cuts[k + 1 :]]
                    value = quality(trial)
                    if value > best + 1e-12:
                        best, cuts, moved = value, trial, True
        if not moved:
            break
    return cuts


def fit_scorer(train: DataFrame, features: list[str], label: str, weight: str | None = None):
    """A penalised linear score of the grade; transform() gives prediction."""
    model = GeneralizedLinearRegression(featuresCol="_features", labelCol=label, regParam=1e-2, family="gaussian", maxIter=25)
    return (model.setWeightCol(weight) if weight else model).fit(assembled(train, features))


def cross_validated(df: DataFrame, features: list[str], label: str, fold: str) -> DataFrame:
    """``df`` with grade_score of the model that has not seen the row's fold; scaling and weights are those of the training rows."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())  # a handful
    out = None
    for k in folds:
        train, held = df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)
        scale = scale_fit(train, features)
        model = fit_scorer(balanced(scaled(train, scale), label), features, label, "_weight")
        scored = model.transform(assembled(scaled(held, scale), features)).select(*[c for c in df.columns if c not in features], F.col("prediction").alias("grade_score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def ablation(df: DataFrame, blocks: dict[str, list[str]], label: str, fold: str, stratum: str) -> list[tuple[str, int, float, bool]]:
    """(block, features, kappa within strata, kept): blocks join one after the other; one is kept if kappa rises.

    Rows are read once, and scored once a block, as fits and cut points pass over them many times.
    """
    used: list[str] = []
    best, out = -2.0, []
    given = df.select(*dict.fromkeys([label, fold, stratum, *(c for own in blocks.values() for c in own)])).persist()
    try:
        for name, columns in blocks.items():
            used = used + columns
            scored = cross_validated(given, used, label, fold).select(label, stratum, "grade_score").persist()
            try:
                cuts = fit_cutpoints(scored, "grade_score", label)
                rows = scored.withColumn("predicted", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("grade_score"))))
                value = within_strata(lambda d, by: kappa(d, label, "predicted", by), rows, stratum, "kappa").first()["mean"]
            finally:
                scored.unpersist()
            kept = value is not None and value > best
            best = value if kept else best
            out.append((name, len(used), value, kept))
    finally:
        given.unpersist()
    return out
