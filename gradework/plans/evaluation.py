"""Queries of the metric layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .inputs import PREDICTIONS_SQL, longs, predictions, rounded

QUERIES, ORACLES = {}, {}


def _add(name, query, sql):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_KAPPA = "1 - CAST(count(*) AS DOUBLE) * sum((truth - predicted) * (truth - predicted)) / nullif(CAST(count(*) AS DOUBLE) * (sum(truth * truth) + sum(predicted * predicted)) - 2 * CAST(sum(truth) AS DOUBLE) * sum(predicted), 0)"


def _auc_sql(by: str) -> str:
    group, part = (f"GROUP BY {by}", f"PARTITION BY {by}") if by else ("", "")
    first = f"{by}, " if by else ""
    return f"""r AS (SELECT {first}referable, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {first}score) - 1) / 2.0::DOUBLE AS rk FROM p),
a AS (SELECT {first}count(*) AS n, (sum(CASE WHEN referable = 1 THEN rk END) - CAST(sum(referable) AS DOUBLE) * (sum(referable) + 1) / 2.0) / nullif(CAST(sum(referable) AS DOUBLE) * (count(*) - sum(referable)), 0) AS auc FROM r {group})"""


_add("confusion_matrix", lambda s, d: longs(M.confusion(predictions(s, d), "truth", "predicted"), "truth", "predicted", "n"),
     f"WITH {PREDICTIONS_SQL}, c AS (SELECT truth, predicted, count(*) AS n FROM p GROUP BY ALL) SELECT CAST(t AS BIGINT) AS truth, CAST(q AS BIGINT) AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(5) a(t), range(5) b(q) LEFT JOIN c ON c.truth = t AND c.predicted = q")
_add("qwk", lambda s, d: rounded(M.kappa(predictions(s, d), "truth", "predicted"), "kappa"), f"WITH {PREDICTIONS_SQL} SELECT count(*) AS n, round({_KAPPA}, 6) AS kappa FROM p")
_add("qwk_by_stratum", lambda s, d: rounded(M.kappa(predictions(s, d), "truth", "predicted", ["stratum"]), "kappa"), f"WITH {PREDICTIONS_SQL} SELECT stratum, count(*) AS n, round({_KAPPA}, 6) AS kappa FROM p GROUP BY stratum")
_add("qwk_within", lambda s, d: rounded(longs(M.within_strata(lambda x, by: M.kappa(x, "truth", "predicted", by), predictions(s, d), "stratum", "kappa"), "strata", "skipped"), "mean"),
     f"WITH {PREDICTIONS_SQL}, k AS (SELECT stratum, count(*) AS n, {_KAPPA} AS kappa FROM p GROUP BY stratum) SELECT round(avg(CASE WHEN n >= 10 THEN kappa END), 6) AS mean, count(CASE WHEN n >= 10 THEN kappa END) AS strata, CAST(sum(CASE WHEN n >= 10 THEN 0 ELSE 1 END) AS BIGINT) AS skipped FROM k")
_add("roc_auc", lambda s, d: rounded(M.auc(predictions(s, d), "referable", "score"), "auc"), f"WITH {PREDICTIONS_SQL}, {_auc_sql('')} SELECT n, round(auc, 6) AS auc FROM a")
_add("auc_by_stratum", lambda s, d: rounded(M.auc(predictions(s, d), "referable", "score", ["stratum"]), "auc"), f"WITH {PREDICTIONS_SQL}, {_auc_sql('stratum')} SELECT stratum, n, round(auc, 6) AS auc FROM a")
_add("auc_within", lambda s, d: rounded(longs(M.within_strata(lambda x, by: M.auc(x, "referable", "score", by), predictions(s, d), "stratum", "auc"), "strata", "skipped"), "mean"),
     f"WITH {PREDICTIONS_SQL}, {_auc_sql('stratum')} SELECT round(avg(CASE WHEN n >= 10 THEN auc END), 6) AS mean, count(CASE WHEN n >= 10 THEN auc END) AS strata, CAST(sum(CASE WHEN n >= 10 THEN 0 ELSE 1 END) AS BIGINT) AS skipped FROM a")
_add("sens_spec", lambda s, d: rounded(M.sensitivity_specificity(predictions(s, d), "referable", "score", F.lit(2.0), ["stratum"]), "sensitivity", "specificity"),
     f"WITH {PREDICTIONS_SQL} SELECT stratum, round(avg(CASE WHEN referable = 1 THEN CASE WHEN score >= 2 THEN 1.0 ELSE 0.0 END END), 6) AS sensitivity, round(avg(CASE WHEN referable = 0 THEN CASE WHEN score >= 2 THEN 0.0 ELSE 1.0 END END), 6) AS specificity FROM p GROUP BY stratum")
_POINT = """t AS (SELECT {g} sum(referable) AS pos, count(*) - sum(referable) AS neg FROM p {gb}),
w AS (SELECT DISTINCT {g} score AS threshold, sum(referable) OVER ({pb} ORDER BY score DESC) AS tp, sum(1 - referable) OVER ({pb} ORDER BY score DESC) AS fp FROM p),
z AS (SELECT w.*, tp / CAST(pos AS DOUBLE) AS sensitivity, (neg - fp) / CAST(neg AS DOUBLE) AS specificity, tp / CAST(pos AS DOUBLE) >= 0.9 AS reached FROM w JOIN t {on}),
n AS (SELECT *, row_number() OVER ({pb} ORDER BY reached DESC, CASE WHEN reached THEN -threshold ELSE threshold END) AS nth FROM z)"""
_add("operating_point", lambda s, d: rounded(M.operating_point(predictions(s, d), "referable", "score"), "threshold", "sensitivity", "specificity"),
     f"WITH {PREDICTIONS_SQL}, {_POINT.format(g='', gb='', pb='', on='ON true')} SELECT round(threshold, 6) AS threshold, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, reached FROM n WHERE nth = 1")
_add("operating_point_by_stratum", lambda s, d: rounded(M.operating_point(predictions(s, d), "referable", "score", ["stratum"]), "threshold", "sensitivity", "specificity"),
     f"WITH {PREDICTIONS_SQL}, {_POINT.format(g='stratum,', gb='GROUP BY stratum', pb='PARTITION BY stratum', on='USING (stratum)')} SELECT stratum, round(threshold, 6) AS threshold, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, reached FROM n WHERE nth = 1")
_BINS = "b AS (SELECT *, " + " + ".join(f"CASE WHEN probability >= {k / 10}::DOUBLE THEN 1 ELSE 0 END" for k in range(1, 10)) + " AS bin FROM p)"
_add("ece_reliability", lambda s, d: rounded(longs(M.reliability(predictions(s, d), "referable", "probability"), "bin", "n"), "confidence", "accuracy"),
     f"WITH {PREDICTIONS_SQL}, {_BINS}, c AS (SELECT bin, count(*) AS n, avg(probability) AS confidence, avg(referable) AS accuracy FROM b GROUP BY bin) SELECT CAST(k AS BIGINT) AS bin, coalesce(n, 0) AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM range(10) t(k) LEFT JOIN c ON c.bin = k")
_add("calibration_error", lambda s, d: rounded(M.calibration_error(predictions(s, d), "referable", "probability", by=["stratum"]), "ece"),
     f"WITH {PREDICTIONS_SQL}, {_BINS}, c AS (SELECT stratum, bin, count(*) AS n, abs(avg(referable) - avg(probability)) AS gap FROM b GROUP BY stratum, bin) SELECT stratum, round(sum(n * gap) / sum(n), 6) AS ece FROM c GROUP BY stratum")
_add("per_class_sensitivity", lambda s, d: rounded(longs(M.class_sensitivity(predictions(s, d), "truth", "predicted"), "grade", "n"), "sensitivity"),
     f"WITH {PREDICTIONS_SQL} SELECT CAST(k AS BIGINT) AS grade, count(truth) AS n, round(avg(CASE WHEN truth = predicted THEN 1.0 WHEN truth IS NOT NULL THEN 0.0 END), 6) AS sensitivity FROM range(5) t(k) LEFT JOIN p ON truth = k GROUP BY k")
_add("class_weights", lambda s, d: rounded(longs(M.class_weights(predictions(s, d), "truth"), "grade", "n"), "weight"),
     f"WITH {PREDICTIONS_SQL}, c AS (SELECT k AS grade, count(truth) AS n FROM range(5) t(k) LEFT JOIN p ON truth = k GROUP BY k) SELECT grade, n, round(coalesce(sum(n) OVER () / 5.0::DOUBLE / nullif(n, 0), 1.0), 6) AS weight FROM c")
_add("spearman_within", lambda s, d: rounded(M.spearman(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "rho"),
     "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS rho, abs(corr(a, b)) > 0.3 AS flagged FROM r GROUP BY l_returnflag")
_add("report_by_stratum", lambda s, d: rounded(M.summary(predictions(s, d), "truth", "predicted", "score", 2.0, ["stratum"]), "kappa", "auc", "sensitivity", "specificity"),
     f"WITH {PREDICTIONS_SQL}, {_auc_sql('stratum')}, k AS (SELECT stratum, count(*) AS n, {_KAPPA} AS kappa, avg(CASE WHEN referable = 1 THEN CASE WHEN score >= 2 THEN 1.0 ELSE 0.0 END END) AS sensitivity, avg(CASE WHEN referable = 0 THEN CASE WHEN score >= 2 THEN 0.0 ELSE 1.0 END END) AS specificity FROM p GROUP BY stratum) SELECT stratum, k.n, round(kappa, 6) AS kappa, round(auc, 6) AS auc, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity FROM k JOIN a USING (stratum)")
_add("stratified_grading_report", lambda s, d: rounded(M.kappa(predictions(s, d), "truth", "predicted", ["stratum"]).join(M.auc(predictions(s, d), "referable", "score", ["stratum"]).drop("n"), "stratum"), "kappa", "auc"),
     f"WITH {PREDICTIONS_SQL}, {_auc_sql('stratum')}, k AS (SELECT stratum, count(*) AS n, {_KAPPA} AS kappa FROM p GROUP BY stratum) SELECT stratum, k.n, round(kappa, 6) AS kappa, round(auc, 6) AS auc FROM k JOIN a USING (stratum)")


def _bootstrap(s, d):
    rows = s.read.parquet(f"{d}/labels.parquet").join(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select("doc_id", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"))
    drawn = M.resampled(rows, "doc_id", 20)
    return rounded(longs(M.interval(M.auc(drawn, "label", "score", ["draw"]), "auc"), "n_boot"), "lo", "hi")


_add("bootstrap_ci", _bootstrap,
     """WITH s AS (SELECT doc_id, quality AS label, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM labels JOIN documents USING (doc_id)),
d AS (SELECT b AS draw, CAST('0x' || substr(md5('0|' || b || '|' || i), 1, 8) AS BIGINT) % (SELECT count(*) FROM s) AS k FROM range(20) t(b), range((SELECT count(*) FROM s)) u(i)),
r AS (SELECT draw, label, rank() OVER (PARTITION BY draw ORDER BY score) + (count(*) OVER (PARTITION BY draw, score) - 1) / 2.0::DOUBLE AS rk FROM d JOIN s USING (k)),
a AS (SELECT draw, (sum(CASE WHEN label = 1 THEN rk END) - CAST(sum(label) AS DOUBLE) * (sum(label) + 1) / 2.0) / nullif(CAST(sum(label) AS DOUBLE) * (count(*) - sum(label)), 0) AS auc FROM r GROUP BY draw)
SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi, count(auc) AS n_boot FROM a""")
