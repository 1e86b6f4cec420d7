"""Bindings of the driver's tables to the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster

CUTS = (0.7, 1.9, 3.1, 4.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, truth, score, probability, predicted, stratum, referable) from orders and customers."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    truth = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    score = (truth * 20 + (F.col("o_orderkey") * 37) % 61).cast("double") / 25.0
    rows = orders.select(F.col("o_orderkey").alias("id"), "o_custkey", truth.alias("truth"), score.alias("score"))
    rows = rows.join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("stratum")), "o_custkey").drop("o_custkey")
    cuts = F.array(*map(F.lit, CUTS))
    return rows.withColumns(
        {"probability": F.least(F.col("score") / 5.6, F.lit(1.0)), "predicted": F.size(F.filter(cuts, lambda c: c < F.col("score"))), "referable": (F.col("truth") >= 2).cast("int")}
    )


#: The same relation for the oracle.
PREDICTIONS_SQL = """pred AS (
  SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS truth,
         CAST((CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) * 20 + (o_orderkey * 37) % 61 AS DOUBLE) / CAST(25.0 AS DOUBLE) AS score, c_mktsegment AS stratum
  FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT *, least(score / CAST(5.6 AS DOUBLE), 1.0) AS probability,
         (CASE WHEN score > 0.7::DOUBLE THEN 1 ELSE 0 END + CASE WHEN score > 1.9::DOUBLE THEN 1 ELSE 0 END + CASE WHEN score > 3.1::DOUBLE THEN 1 ELSE 0 END + CASE WHEN score > 4.3::DOUBLE THEN 1 ELSE 0 END) AS predicted,
         CASE WHEN truth >= 2 THEN 1 ELSE 0 END AS referable FROM pred)"""


def grid(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    """(vec_id, y, x, v): every embedding as an 8 x 8 image."""
    return raster.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, *carry)


GRID_SQL = """g AS (SELECT vec_id, label, CAST((pos - 1) // 8 AS INTEGER) AS y, CAST((pos - 1) % 8 AS INTEGER) AS x, CAST(embedding[pos] AS DOUBLE) AS v
  FROM embeddings, unnest(range(1, 65)) AS t(pos))"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})
