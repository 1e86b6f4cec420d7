"""Evaluation metrics as aggregations, over all rows or by grouping columns.

Undefined results are null: an AUC of one class, a kappa without expected disagreement, a rate of no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import percentiles, ranks, running_sums

GRADES = 5
REFERABLE = 2
TARGET_SENSITIVITY = 0.90


def graded(value: Column, classes: int = GRADES) -> Column:
    """Nearest class (half to even), inside the range of classes."""
    return F.least(F.greatest(F.bround(value.cast("double"), 0), F.lit(0.0)), F.lit(float(classes - 1))).cast("int")


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None, classes: int = GRADES) -> DataFrame:
    """(by..., truth, predicted, n) with a row for every pair of classes."""
    by = by or []
    counted = df.groupBy(*by, graded(F.col(truth), classes).alias("truth"), graded(F.col(predicted), classes).alias("predicted")).agg(F.count("*").alias("n"))
    every = F.array(*(F.struct(F.lit(t).alias("truth"), F.lit(p).alias("predicted")) for t in range(classes) for p in range(classes)))
    cells = counted.select(*by).distinct() if by else counted.limit(1).select()
    cells = cells.select(*by, F.inline(every))
    return cells.join(counted, [*by, "truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def kappa(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None, classes: int = GRADES) -> DataFrame:
    """(by..., n, kappa): quadratic weighted kappa in one aggregation.

    Observed disagreement is the sum of (t - p)^2; the expected one, over all pairs of rows, follows from
    the first two moments: n (sum t^2 + sum p^2) - 2 sum t sum p.
    """
    t, p = graded(F.col(truth), classes).cast("double"), graded(F.col(predicted), classes).cast("double")
    n = F.count("*")
    expected = n * (F.sum(t * t) + F.sum(p * p)) - 2 * F.sum(t) * F.sum(p)
    return df.groupBy(*(by or [])).agg(n.alias("n"), (1 - F.try_divide(n * F.sum((t - p) * (t - p)), F.nullif(expected, F.lit(0.0)))).alias("kappa"))


def auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, auc): area under the ROC curve, ties by half.

    Rows are first counted by distinct score, so what is ordered is as long as there are scores.
    """
    by = by or []
    positive = F.col(label).cast("int")
    counted = df.groupBy(*by, F.col(score).alias("_score")).agg(F.sum(positive).alias("_pos"), F.sum(1 - positive).alias("_neg"))
    ranked = running_sums(counted, "_score", {"_upto": "_neg"}, by)
    won = F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.groupBy(*by).agg((F.sum("_pos") + F.sum("_neg")).alias("n"), F.try_divide(won, F.nullif(pairs, F.lit(0.0))).alias("auc"))


def sensitivity_specificity(df: DataFrame, label: str, score: str, threshold: Column | float, by: list[str] | None = None) -> DataFrame:
    """(by..., sensitivity, specificity); a score at the threshold is positive."""
    flagged = F.col(score) >= threshold
    positive = F.col(label) == 1
    rate = lambda hit, of: F.avg(F.when(of, hit.cast("double")))
    return df.groupBy(*(by or [])).agg(rate(flagged, positive).alias("sensitivity"), rate(~flagged, ~positive).alias("specificity"))


def operating_point(df: DataFrame, label: str, score: str, by: list[str] | None = None, target: float = TARGET_SENSITIVITY) -> DataFrame:
    """(by..., threshold, sensitivity, specificity, reached): the highest threshold that reaches the target, else the lowest score."""
    by = by or []
    positive = F.col(label).cast("int")
    counted = df.groupBy(*by, F.col(score).alias("_score")).agg(F.sum(positive).alias("_pos"), F.sum(1 - positive).alias("_neg"))
    totals = counted.groupBy(*by).agg(F.sum("_pos").alias("_all_pos"), F.sum("_neg").alias("_all_neg"))
    walk = running_sums(counted, "_score", {"_tp": "_pos", "_fp": "_neg"}, by, descending=True)
    walk = walk.join(totals, by) if by else walk.crossJoin(F.broadcast(totals))  # one row
    walk = walk.filter("_all_pos > 0").withColumn("sensitivity", F.col("_tp") / F.col("_all_pos")).withColumn("specificity", F.try_divide(F.col("_all_neg") - F.col("_fp"), F.nullif("_all_neg", F.lit(0))))
    walk = walk.withColumn("reached", F.col("sensitivity") >= target)
    best = F.max_by(F.struct(F.col("_score").alias("threshold"), "sensitivity", "specificity", "reached"), F.struct("reached", F.when(F.col("reached"), F.col("_score")).otherwise(-F.col("_score"))))
    return walk.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def reliability(df: DataFrame, label: str, probability: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by..., bin, n, confidence, accuracy) of equal bins, the last one closed; empty bins have n = 0."""
    by = by or []
    edges = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    place = F.size(F.filter(edges, lambda e: e <= F.col(probability)))
    counted = df.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))
    cells = counted.select(*by).distinct() if by else counted.limit(1).select()
    cells = cells.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return cells.join(counted, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(df: DataFrame, label: str, probability: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by..., ece): mean gap of confidence and accuracy, weighted by rows."""
    gaps = reliability(df, label, probability, bins, by).filter("n > 0")
    return gaps.groupBy(*(by or [])).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def class_sensitivity(df: DataFrame, truth: str, predicted: str, classes: int = GRADES) -> DataFrame:
    """(grade, n, sensitivity) of every class."""
    cells = confusion(df, truth, predicted, classes=classes)
    hit = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    return cells.groupBy(F.col("truth").alias("grade")).agg(F.sum("n").alias("n"), F.try_divide(hit, F.nullif(F.sum("n"), F.lit(0))).alias("sensitivity"))


def within_strata(metric: Callable[[DataFrame, list[str]], DataFrame], df: DataFrame, stratum: str, value: str, min_rows: int = 10) -> DataFrame:
    """(mean, strata, skipped): the unweighted mean of a grouped metric over strata with enough rows and a defined value."""
    rows = metric(df, [stratum])
    enough = F.col("n") >= min_rows
    return rows.agg(
        F.avg(F.when(enough, F.col(value))).alias("mean"),
        F.count(F.when(enough, F.col(value))).alias("strata"),
        F.sum(F.when(enough, 0).otherwise(1)).alias("skipped"),
    )


def spearman(df: DataFrame, a: str, b: str, by: list[str], flag_from: float = 0.3) -> DataFrame:
    """(by..., n, rho, flagged): Pearson correlation of average ranks, which rows meet by their values."""
    ranked = df.select(*by, F.col(a).alias("_x"), F.col(b).alias("_y"))
    for column, old, new in (("_x", a, "_a"), ("_y", b, "_b")):
        known = ranks(df.select(*by, F.col(old).alias(column)), column, by, new)
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*by, column)]
        ranked = ranked.alias("l").join(known.alias("r"), same).select(*(F.col(f"l.{c}") for c in ranked.columns), new)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("rho")).withColumn("flagged", F.abs("rho") > flag_from)


def resampled(df: DataFrame, key: str, draws: int, seed: int = 0) -> DataFrame:
    """Bootstrap: ``draws`` resamples of ``df``, each as long, with replacement; adds draw.

    Place i of draw b takes the row whose number is a hash of (b, i) modulo the count.  Numbers come from
    ranges of ``key``, which must be distinct; resamples meet rows by an equi-join on the number.
    """
    n = df.count()
    numbered = running_sums(df.withColumn("_one", F.lit(1)), key, {"_number": "_one"}).withColumn("_number", F.col("_number") - 1).drop("_one")
    places = df.sparkSession.range(n).withColumnRenamed("id", "_i").select("_i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picked = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("_i").cast("string"))), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))
    return places.select("draw", picked.alias("_number")).join(numbered, "_number").drop("_number")


def interval(samples: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """(lo, hi, n_boot): percentile interval of the defined values."""
    return samples.agg(F.percentile(value, F.lit(alpha / 2)).alias("lo"), F.percentile(value, F.lit(1 - alpha / 2)).alias("hi"), F.count(value).alias("n_boot"))


def summary(df: DataFrame, truth: str, predicted: str, score: str, threshold: float, by: list[str]) -> DataFrame:
    """(by..., n, kappa, auc, sensitivity, specificity): one report row a group."""
    rows = df.withColumn("_referable", (F.col(truth) >= REFERABLE).cast("int"))
    out = kappa(rows, truth, predicted, by)
    out = out.join(auc(rows, "_referable", score, by).drop("n"), by)
    return out.join(sensitivity_specificity(rows, "_referable", score, F.lit(threshold), by), by)


def with_pooled(df: DataFrame, stratum: str, pooled: str = "pooled") -> DataFrame:
    """Every row once under its stratum and once under ``pooled``; a null stratum is in the pool alone."""
    return df.withColumn(stratum, F.explode(F.array_compact(F.array(F.col(stratum).cast("string"), F.lit(pooled)))))


def stratum_thresholds(df: DataFrame, stratum: str, metrics: dict[str, dict[str, float]], min_rows: int = 20, pooled: str = "pooled") -> DataFrame:
    """(stratum, n, thresholds): for each metric {new column: share} its exact percentiles, of strata with enough rows and of all rows."""
    named = df.select(F.col(stratum).cast("string").alias(stratum), *metrics)
    each = named.groupBy(stratum).agg(F.count("*").alias("n"))
    sizes = with_pooled(each, stratum, pooled).groupBy(stratum).agg(F.sum("n").alias("n")).filter((F.col("n") >= min_rows) | (F.col(stratum) == pooled))
    shares = sorted({x for own in metrics.values() for x in own.values()})
    found = percentiles(named, list(metrics), shares, [stratum], pooled=pooled).drop("n")
    columns = [F.max(F.when((F.col("metric") == metric) & (F.col("share") == F.lit(share)), F.col("value"))).alias(name) for metric, own in metrics.items() for name, share in own.items()]
    return sizes.join(found.groupBy(stratum).agg(*columns), stratum, "left")


def profile(df: DataFrame, group: str, metrics: list[str], rejected: str, whole: str = "ALL") -> DataFrame:
    """(group, metric, n, least, q1, middle, q3, most, rejected_pct): five numbers of each metric by group and over all rows.

    n counts a metric's values; rejected_pct is the share of the group's rows whose ``rejected`` holds.
    """
    wide = with_pooled(df.select(group, rejected, *metrics), group, whole)
    names = {0.0: "least", 0.25: "q1", 0.5: "middle", 0.75: "q3", 1.0: "most"}
    named = df.select(F.col(group).cast("string").alias(group), *metrics)
    found = percentiles(named, metrics, list(names), [group], pooled=whole)
    rows = found.groupBy(group, "metric", "n").agg(*(F.max(F.when(F.col("share") == F.lit(x), F.col("value"))).alias(name) for x, name in names.items()))
    gate = wide.groupBy(group).agg((100.0 * F.avg(F.coalesce(F.col(rejected), F.lit(False)).cast("double"))).alias("rejected_pct"))
    return rows.join(gate, group)


def class_weights(df: DataFrame, label: str, classes: int = GRADES) -> DataFrame:
    """(grade, n, weight): total / (classes n), 1 for an empty class."""
    counted = df.groupBy(F.col(label).cast("int").alias("grade")).agg(F.count("*").alias("n"))
    cells = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("grade"))
    dense = cells.join(counted, "grade", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())  # a row for each class
    return dense.withColumn("weight", F.coalesce(F.try_divide(total / classes, F.nullif("n", F.lit(0))), F.lit(1.0)))
