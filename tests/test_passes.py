"""How often queries pass over rows, or look at them one by one."""

import numpy as np
from pyspark.sql import functions as F

from gradework.functions import ordered
from gradework.operators import grading, metrics, perceptron


def test_weights_are_looked_up_by_grade_not_by_row(spark):
    looked = spark.sparkContext.accumulator(0)

    class Weights(dict):
        def __getitem__(self, grade):
            looked.add(1)
            return dict.__getitem__(self, grade)

        def get(self, grade, other=None):
            looked.add(1)
            return dict.get(self, grade, other)

    rows = spark.range(0, 4000, numPartitions=2).select(F.array((F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 3).cast("double").alias("y"), (F.col("id") % 2).cast("string").alias("fold"))
    known = {k: perceptron.Training(np.zeros(1), np.ones(1), Weights({0.0: 1.0, 1.0: 2.0, 2.0: 1.0})) for k in "01"}
    perceptron.fit_folds(rows, 1, known, (4,), steps=1)
    assert 0 < looked.value <= 2 * 2 * 3


def test_ablation_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 600, numPartitions=2).mapInArrow(seen, "id long")
    rows = rows.select((F.col("id") % 5).cast("int").alias("grade"), (F.col("id") % 5 + F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), (F.col("id") % 4).cast("int").alias("fold"), F.lit("s").alias("stratum"))
    found = grading.ablation(rows, {"a": ["a"], "b": ["b"]}, "grade", "fold", "stratum")
    assert [(name, n) for name, n, _, _ in found] == [("a", 1), ("b", 2)] and found[0][3]
    assert read.value == 600


def test_pooled_percentiles_come_from_the_counts_of_groups(spark):
    rows = spark.createDataFrame([(g, float(i * i % 17), None if i % 5 else float(i)) for i in range(60) for g in ("a", "b" if i % 3 else None)], "g string, v double, w double")
    shares = [0.0, 0.02, 0.1, 0.5, 1.0]
    once = ordered.percentiles(rows, ["v", "w"], shares, ["g"], pooled="all")
    twice = ordered.percentiles(metrics.with_pooled(rows, "g", "all"), ["v", "w"], shares, ["g"])
    assert sorted(once.collect()) == sorted(twice.collect()) and once.count() == 3 * 2 * len(shares)
    empty = ordered.percentiles(rows.limit(0), ["v"], shares, ["g"], pooled="all")
    assert empty.collect() == []
