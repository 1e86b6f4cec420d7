"""Queries of fitted models; SQL cannot express them, tests hold them against properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as V
from ..operators import grading as M
from ..operators import perceptron as N
from ..operators import sampling as S
from ..sources import tables
from ..streaming import resume
from .inputs import predictions, rounded, table

QUERIES, ORACLES = {}, {}


def _zscore(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    scale = M.scale_fit(table(s, d, "lineitem").filter("l_returnflag = 'A'"), ["l_quantity", "l_extendedprice"])
    return rounded(M.scaled(rows, scale), "l_quantity", "l_extendedprice")


QUERIES["zscore"] = _zscore
ORACLES["zscore"] = "WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_extendedprice) AS c, stddev_pop(l_extendedprice) AS e FROM lineitem WHERE l_returnflag = 'A') SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - a) / b, 6) AS l_quantity, round((l_extendedprice - c) / e, 6) AS l_extendedprice FROM lineitem, s"


def _labelled(s, d):
    docs = table(s, d, "documents").select("doc_id", F.log1p("n_chars").alias("length"), F.length("source").cast("double").alias("source_length"), F.size(F.split("text", "\n")).cast("double").alias("lines"))
    return table(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")).join(docs, "doc_id")


def _platt(s, d):
    rows = _labelled(s, d)
    slope, intercept = M.platt(rows, "length", "quality")
    return rounded(M.platt_apply(rows.select("doc_id", "length"), "length", slope, intercept), "length", "probability", digits=4)


def _isotonic(s, d):
    rows = _labelled(s, d)
    return rounded(M.isotonic_apply(M.isotonic(rows, "length", "quality"), rows, "length").select("doc_id", "probability"), "probability")


def _forest(s, d):
    rows, features = _labelled(s, d), ["length", "source_length", "lines"]
    model = M.forest(rows.withColumn("quality", F.col("quality").cast("double")), features, "quality", trees=20)
    return rounded(M.forest_score(model, rows, features).select("doc_id", "score"), "score")


def _graded(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("grade"), "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day"), F.col("o_orderstatus").alias("stratum"))
    return rows.withColumns({"signal": F.col("grade") * 2.0 + (F.col("id") * 7919 % 101) / 25.0, "fold": (F.pmod(F.xxhash64("id"), F.lit(5))).cast("int")})


def _cuts(s, d):
    cuts = M.fit_cutpoints(predictions(s, d), "score", "truth")
    return s.createDataFrame([(i + 1, c) for i, c in enumerate(cuts)], "place int, cut double")


QUERIES["platt_fit"] = _platt
QUERIES["isotonic_fit"] = _isotonic
QUERIES["forest_score"] = _forest
QUERIES["fit_cutpoints"] = _cuts
QUERIES["cross_validation"] = lambda s, d: rounded(M.cross_validated(_graded(s, d), ["signal", "o_totalprice", "day"], "grade", "fold"), "grade_score", digits=4)
QUERIES["ablation"] = lambda s, d: s.createDataFrame(M.ablation(_graded(s, d), {"a": ["signal"], "b": ["day"]}, "grade", "fold", "stratum"), "block string, features int, kappa double, kept boolean")
QUERIES["hourly_counts"] = lambda s, d: resume.windowed_counts(table(s, d, "events"), "ts", "event_type")
ORACLES["hourly_counts"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
QUERIES["latest_state"] = lambda s, d: resume.latest_state(table(s, d, "events"), "user_id", "event_id", "event_type", "purchase")
ORACLES["latest_state"] = "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'purchase' ELSE arg_max(event_type, event_id) END AS status FROM events GROUP BY user_id"


def _lesions(s, d):
    """(candidates, images): items as candidates of two lesions, orders as images."""
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("id_code"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("grade"))
    placed = S.split_and_folds(orders, ["grade"], "id_code", 30, folds=3)
    marks = {"od_x": F.lit(300.0), "od_y": F.lit(436.0), "fovea_x": F.lit(500.0), "fovea_y": F.lit(440.0), "venous_beading_quadrants": F.lit(0), "nv_irma_quadrants": F.lit(0)}
    items = table(s, d, "lineitem")
    lesion = F.when(F.col("l_linenumber") % 2 == 0, "haem").otherwise("ma")
    candidates = items.select(
        F.col("l_orderkey").alias("id_code"), lesion.alias("lesion"), (F.col("l_partkey") % 872).cast("double").alias("cx"), (F.col("l_suppkey") * 8 % 872).cast("double").alias("cy"), F.col("l_quantity").alias("area"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    return candidates, placed.withColumns(marks)


_SIGNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _out_of_fold(s, d):
    """Image rows recomputed from candidates that models of other folds have scored; the test images' models have seen all others."""
    candidates, placed = _lesions(s, d)
    # Folds are dealt once, not in every pass of every model.
    path = tables.scratch(s, "images")
    placed.write.parquet(path)
    images = s.read.schema(placed.schema).parquet(path)
    fitted = {k: V.fit_fold(candidates, images, _SIGNS, k, ("ma", "haem"), trees=8) for k in [*V.folds(images), V.TEST]}
    scored = V.scored_out_of_fold(candidates, images, _SIGNS, fitted)
    return V.recomputed(images, scored, 1000.0).select("id_code", "grade", "split", "cv_fold", "haem_count", "ma_count", "haem_q_max", "severe_npdr_flag")


QUERIES["out_of_fold_lesions"] = _out_of_fold
QUERIES["cv_mlp"] = lambda s, d: rounded(N.cross_validated(_graded(s, d), ["signal", "o_totalprice", "day"], "grade", "fold", ["id", "grade"], hidden=(16, 8), steps=40), "grade_score", digits=4)


def _resumed(s, d):
    """Orders of high value, brought into a table by a stream that is stopped and started again."""
    folder = tables.scratch(s, "resume")
    schema = table(s, d, "orders").schema
    step = lambda rows: rows.filter("o_totalprice > 100000").select("o_orderkey", "o_orderpriority", "o_totalprice")
    run = lambda: resume.resume(s, d, schema, step, f"{folder}/table", f"{folder}/checkpoint", "o_orderkey", files="orders.parquet")
    run()
    return rounded(run().groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)


QUERIES["resume_stream"] = _resumed
ORACLES["resume_stream"] = "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority"


def _versioned(s, d):
    """The latest version of a table that has been merged twice, and the number of versions kept."""
    path = tables.scratch(s, "versions")
    part = table(s, d, "part").select("p_partkey", "p_size")
    tables.write_version(part, path)
    tables.write_version(tables.read_version(s, path).withColumn("p_size", F.col("p_size") + 1).filter("p_size > 5"), path)
    return tables.read_version(s, path).withColumn("versions", F.lit(len(tables.versions(s, path))))


QUERIES["versioned_merge"] = _versioned
ORACLES["versioned_merge"] = "SELECT p_partkey, CAST(p_size + 1 AS INTEGER) AS p_size, CAST(2 AS INTEGER) AS versions FROM part WHERE p_size + 1 > 5"
