"""Queries that calibrate: exact percentiles by stratum, illumination fits, samples in discs, balanced draws."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import ordered as O
from ..operators import illumination as L
from ..operators import metrics as M
from ..operators import sampling as S
from .inputs import GRID_SQL, longs, rounded, table

QUERIES, ORACLES = {}, {}

_METRICS = {
    "brenner": {"brenner_fail": 0.02},
    "lap": {"lap_fail": 0.02, "lap_borderline": 0.10},
    "tenengrad": {"tenengrad_fail": 0.02, "tenengrad_borderline": 0.10},
    "region_min": {"region_min_fail": 0.02, "region_min_borderline": 0.10},
}
_SOURCE = {"brenner": "l_quantity", "lap": "l_extendedprice", "tenengrad": "l_discount", "region_min": "l_tax"}
_NAMES = [name for own in _METRICS.values() for name in own]


def _sharpness(s, d):
    """Scores of items by supplier, in place of images by resolution."""
    return table(s, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("resolution"), *(F.col(c).alias(m) for m, c in _SOURCE.items()))


QUERIES["sharpness_thresholds"] = lambda s, d: rounded(M.stratum_thresholds(_sharpness(s, d), "resolution", _METRICS), *_NAMES)
ORACLES["sharpness_thresholds"] = "SELECT coalesce('s' || l_suppkey, 'pooled') AS resolution, count(*) AS n, " + ", ".join(f"round(quantile_cont({_SOURCE[m]}, {share}), 6) AS {name}" for m, own in _METRICS.items() for name, share in own.items()) + " FROM lineitem GROUP BY GROUPING SETS ((l_suppkey), ()) HAVING count(*) >= 20 OR l_suppkey IS NULL"

QUERIES["quality_profile"] = lambda s, d: rounded(M.profile(table(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", (F.col("l_discount") > 0.08).alias("rejected")), "l_returnflag", ["l_quantity", "l_extendedprice"], "rejected"), "least", "q1", "middle", "q3", "most", "rejected_pct")
_FIVE = ", ".join(f"round(quantile_cont(v, {share}), 6) AS {name}" for name, share in (("least", 0.0), ("q1", 0.25), ("middle", 0.5), ("q3", 0.75), ("most", 1.0)))
ORACLES["quality_profile"] = f"WITH m AS (UNPIVOT (SELECT l_returnflag, l_discount > 0.08::DOUBLE AS rejected, l_quantity, l_extendedprice FROM lineitem) ON l_quantity, l_extendedprice INTO NAME metric VALUE v) SELECT coalesce(l_returnflag, 'ALL') AS l_returnflag, metric, count(*) AS n, {_FIVE}, round(100 * avg(CASE WHEN rejected THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS rejected_pct FROM m GROUP BY GROUPING SETS ((l_returnflag, metric), (metric))"


def _merge_summary(s, d):
    """Range and middle of each metric, and its middle by grade."""
    rows = table(s, d, "orders").select(F.substring("o_orderpriority", 1, 1).alias("grade"), "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day"))
    whole = O.percentiles(rows, ["o_totalprice", "day"], [0.0, 0.5, 1.0])
    wide = whole.groupBy("metric", "n").agg(*(F.max(F.when(F.col("share") == x, F.col("value"))).alias(name) for x, name in ((0.0, "least"), (0.5, "middle"), (1.0, "most"))))
    by_grade = O.percentiles(rows, ["o_totalprice", "day"], [0.5], ["grade"]).groupBy("metric").agg(*(F.max(F.when(F.col("grade") == str(g), F.col("value"))).alias(f"middle_{g}") for g in range(1, 6)))
    return rounded(wide.join(by_grade, "metric"), "least", "middle", "most", *(f"middle_{g}" for g in range(1, 6)))


QUERIES["merge_summary"] = _merge_summary
ORACLES["merge_summary"] = "WITH m AS (UNPIVOT (SELECT substr(o_orderpriority, 1, 1) AS grade, o_totalprice, CAST(dayofyear(o_orderdate) AS DOUBLE) AS day FROM orders) ON o_totalprice, day INTO NAME metric VALUE v) SELECT metric, count(*) AS n, round(min(v), 6) AS least, round(median(v), 6) AS middle, round(max(v), 6) AS most, " + ", ".join(f"round(median(v) FILTER (grade = '{g}'), 6) AS middle_{g}" for g in range(1, 6)) + " FROM m GROUP BY metric"

QUERIES["linear_percentile"] = lambda s, d: rounded(O.percentiles(table(s, d, "events"), ["value"], [0.0, 0.02, 0.1, 0.5, 0.92, 1.0], ["event_type"]), "value")
ORACLES["linear_percentile"] = "SELECT event_type, 'value' AS metric, count(*) AS n, share, round(quantile_cont(value, share), 6) AS value FROM events, (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in (0.0, 0.02, 0.1, 0.5, 0.92, 1.0)) + ") t(share) GROUP BY event_type, share"
ORACLES["linear_percentile"] = " UNION ALL ".join(f"SELECT event_type, 'value' AS metric, count(*) AS n, {x}::DOUBLE AS share, round(quantile_cont(value, {x}), 6) AS value FROM events GROUP BY event_type" for x in (0.0, 0.02, 0.1, 0.5, 0.92, 1.0))

_FIT = ["plane_x", "plane_y", "plane_0", "radial_2", "radial_1", "radial_0", "plane_error", "radial_error", "tilt", "falloff"]


def _illumination(s, d):
    """Grids of embeddings; the cells that count are those of a disc, or not below -0.1 for odd labels."""
    lit = F.expr("transform(sequence(0, 63), p -> if(label % 2 = 1, embedding[p] > -0.1D, hypot(p % 8 - 3, p div 8 - 4) <= 3.7D))")
    return rounded(L.illumination(table(s, d, "embeddings").withColumn("inside", lit), "vec_id", "embedding", 8, "inside"), *_FIT)


QUERIES["illumination_fit"] = _illumination
_DET = lambda a, b, c, d, e, f, g, h, i: f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
ORACLES["illumination_fit"] = f"""WITH {GRID_SQL}, k AS (SELECT * FROM g WHERE CASE WHEN label % 2 = 1 THEN v > -0.1::DOUBLE ELSE sqrt(CAST((x - 3) * (x - 3) + (y - 4) * (y - 4) AS DOUBLE)) <= 3.7::DOUBLE END),
c AS (SELECT *, x - avg(x) OVER w AS u, y - avg(y) OVER w AS t FROM k WINDOW w AS (PARTITION BY vec_id)), r AS (SELECT *, sqrt(u * u + t * t) AS d FROM c), m AS (SELECT *, d / (max(d) OVER (PARTITION BY vec_id) + 1e-6) AS q FROM r),
s AS (SELECT vec_id, count(*) AS n, CAST(count(*) AS DOUBLE) AS q0, sum(u*u) AS uu, sum(u*t) AS uw, sum(t*t) AS ww, sum(u*v) AS uv, sum(t*v) AS wv, sum(q) AS q1, sum(q**2) AS q2, sum(q**3) AS q3, sum(q**4) AS q4, sum(q*v) AS qv, sum(q*q*v) AS q2v, sum(v) AS sv, covar_pop(d, v) / var_pop(d) AS slope FROM m GROUP BY vec_id),
p AS (SELECT *, (uv*ww - wv*uw) / nullif(round(uu*ww - uw*uw, 9), 0) AS px, (wv*uu - uv*uw) / nullif(round(uu*ww - uw*uw, 9), 0) AS py, sv / n AS p0,
{_DET("q2v", "q3", "q2", "qv", "q2", "q1", "sv", "q1", "q0")} / nullif(round({_DET("q4", "q3", "q2", "q3", "q2", "q1", "q2", "q1", "q0")}, 9), 0) AS r2,
{_DET("q4", "q2v", "q2", "q3", "qv", "q1", "q2", "sv", "q0")} / nullif(round({_DET("q4", "q3", "q2", "q3", "q2", "q1", "q2", "q1", "q0")}, 9), 0) AS r1,
{_DET("q4", "q3", "q2v", "q3", "q2", "qv", "q2", "q1", "sv")} / nullif(round({_DET("q4", "q3", "q2", "q3", "q2", "q1", "q2", "q1", "q0")}, 9), 0) AS r0 FROM s WHERE n >= 10),
e AS (SELECT m.vec_id, avg((v - px*u - py*t - p0) ** 2) AS pe, avg((v - r2*q*q - r1*q - r0) ** 2) AS re FROM m JOIN p USING (vec_id) GROUP BY m.vec_id)
SELECT s.vec_id, s.n AS pixels, round(px, 6) AS plane_x, round(py, 6) AS plane_y, round(p0, 6) AS plane_0, round(r2, 6) AS radial_2, round(r1, 6) AS radial_1, round(r0, 6) AS radial_0, round(pe, 6) AS plane_error, round(re, 6) AS radial_error,
round(sqrt(px*px + py*py) * sqrt(p.n / pi()), 6) AS tilt, round(p.slope * sqrt(p.n / pi()), 6) AS falloff, CASE WHEN round(pe, 12) <= round(re, 12) THEN 'plane' WHEN re IS NOT NULL THEN 'radial' END AS model FROM s LEFT JOIN p USING (vec_id) LEFT JOIN e USING (vec_id)"""


def _frames(s, d):
    """Sizes of images, in place of the images."""
    return table(s, d, "embeddings").select("vec_id", (24 + F.col("label") * 3).alias("height"), (30 - F.col("label")).alias("width"))


_DRAW = lambda name, i: f"CAST('0x' || substr(md5(vec_id || '|0|{name}|' || {i}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"
_FRAMES_SQL = "f AS (SELECT vec_id, 24 + label * 3 AS h, 30 - label AS w, 0.75::DOUBLE * (24 + label * 3) / 2 AS rad FROM embeddings)"
QUERIES["points_in_disc"] = lambda s, d: longs(S.points_in_disc(_frames(s, d), "vec_id", "height", "width"), "nth", "y", "x")
ORACLES["points_in_disc"] = f"""WITH {_FRAMES_SQL}, n AS (SELECT *, CAST(greatest(round_even({math.pi!r}::DOUBLE * rad * rad * 0.10::DOUBLE, 0), 1) AS BIGINT) AS wanted FROM f), t AS (SELECT *, unnest(range(wanted * 3)) AS i FROM n),
p AS (SELECT *, CAST(trunc(h // 2 + rad * sqrt({_DRAW("r", "i")}) * sin(2 * {math.pi!r}::DOUBLE * {_DRAW("a", "i")})) AS BIGINT) AS y, CAST(trunc(w // 2 + rad * sqrt({_DRAW("r", "i")}) * cos(2 * {math.pi!r}::DOUBLE * {_DRAW("a", "i")})) AS BIGINT) AS x FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS nth FROM p WHERE y >= 2 AND y < h - 2 AND x >= 2 AND x < w - 2) SELECT vec_id, nth, y, x FROM k WHERE nth < wanted"""
QUERIES["squares_in_disc"] = lambda s, d: longs(S.squares_in_disc(_frames(s, d), "vec_id", "height", "width"), "nth", "y0", "y1", "x0", "x1")
ORACLES["squares_in_disc"] = f"""WITH {_FRAMES_SQL}, n AS (SELECT *, CAST(greatest(round_even(sqrt({math.pi!r}::DOUBLE * rad * rad * 0.025::DOUBLE), 0), 4) AS BIGINT) AS side FROM f), t AS (SELECT *, unnest(range(400)) AS i FROM n),
p AS (SELECT *, CAST(trunc(h // 2 + (rad - side) * sqrt({_DRAW("r", "i")}) * sin(2 * {math.pi!r}::DOUBLE * {_DRAW("a", "i")})) AS BIGINT) - side // 2 AS y0, CAST(trunc(w // 2 + (rad - side) * sqrt({_DRAW("r", "i")}) * cos(2 * {math.pi!r}::DOUBLE * {_DRAW("a", "i")})) AS BIGINT) - side // 2 AS x0 FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS nth FROM p WHERE y0 >= 0 AND x0 >= 0 AND y0 + side < h AND x0 + side < w) SELECT vec_id, nth, y0, y0 + side AS y1, x0, x0 + side AS x1 FROM k WHERE nth < 8"""
QUERIES["oversample"] = lambda s, d: S.oversampled(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")
ORACLES["oversample"] = """WITH o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '|0'), o_orderkey) - 1 AS number FROM orders), c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
d AS (SELECT *, unnest(range((SELECT max(n) FROM c))) AS draw FROM c), p AS (SELECT *, CAST(floor(CAST('0x' || substr(md5(o_orderpriority || '|0|' || draw), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE * n) AS BIGINT) AS number FROM d) SELECT o_orderkey, o_orderpriority, draw FROM p JOIN o USING (o_orderpriority, number)"""
