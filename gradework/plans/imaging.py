"""Queries of raster operators, on embeddings as 8 x 8 images."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import anatomy as A
from ..operators import images as P
from ..operators import kernels as N
from ..operators import lesion as L
from ..operators import raster as X
from .inputs import GRID_SQL, grid, longs, rounded, table

QUERIES, ORACLES = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_ROW, _COL = "(PARTITION BY vec_id, y ORDER BY x)", "(PARTITION BY vec_id, x ORDER BY y)"
_LAP = f"l AS (SELECT *, lag(v) OVER {_ROW} + lead(v) OVER {_ROW} + lag(v) OVER {_COL} + lead(v) OVER {_COL} - 4 * v AS lap FROM g)"
_SHIFTED = lambda df: df.withColumn("v", F.col("v") + 1)  # noqa: E731  intensities away from 0

_add("laplacian_grid", lambda s, d: rounded(X.normed_laplacian(_SHIFTED(grid(s, d)), "vec_id"), "lap_norm"), f"WITH {GRID_SQL}, {_LAP} SELECT vec_id, round(var_pop(lap) / pow(avg(v + 1) + 1e-6, 2), 6) AS lap_norm FROM l GROUP BY vec_id")
_add("brenner_grid", lambda s, d: rounded(X.brenner(grid(s, d), "vec_id"), "brenner"),
     f"WITH {GRID_SQL}, l AS (SELECT vec_id, lead(v, 2) OVER {_ROW} - v AS h, lead(v, 2) OVER {_COL} - v AS w FROM g) SELECT vec_id, round((avg(h * h) + avg(w * w)) / 2, 6) AS brenner FROM l GROUP BY vec_id")
_PAD = """e AS (SELECT vec_id, py AS y, px AS x, v FROM range(-{k}, 8 + {k}) a(py), range(-{k}, 8 + {k}) b(px) JOIN g ON g.y = (CASE WHEN py < 0 THEN -1 - py WHEN py >= 8 THEN 15 - py ELSE py END) AND g.x = (CASE WHEN px < 0 THEN -1 - px WHEN px >= 8 THEN 15 - px ELSE px END))"""
_add("tenengrad_grid", lambda s, d: rounded(X.tenengrad(_SHIFTED(grid(s, d)), "vec_id", 8, 8), "tenengrad"),
     f"""WITH {GRID_SQL}, {_PAD.format(k=1)}, n AS (SELECT c.vec_id, c.y, c.x, any_value(c.v) FILTER (o.y = c.y AND o.x = c.x) + 1 AS v,
sum((o.v + 1) * (o.x - c.x) * (2 - abs(o.y - c.y))) AS gx, sum((o.v + 1) * (o.y - c.y) * (2 - abs(o.x - c.x))) AS gy FROM e c JOIN e o ON o.vec_id = c.vec_id AND o.y BETWEEN c.y - 1 AND c.y + 1 AND o.x BETWEEN c.x - 1 AND c.x + 1 WHERE c.y BETWEEN 0 AND 7 AND c.x BETWEEN 0 AND 7 GROUP BY c.vec_id, c.y, c.x),
m AS (SELECT vec_id, gx*gx + gy*gy AS gg, v FROM n) SELECT vec_id, round(var_pop(gg) / pow(avg(v) + 1e-6, 2), 6) AS tenengrad FROM m GROUP BY vec_id""")
_add("region_min_grid", lambda s, d: rounded(X.region_minimum(_SHIFTED(grid(s, d)), "vec_id", 8, 8), "score"),
     f"""WITH {GRID_SQL}, {_LAP}, i AS (SELECT * FROM l WHERE lap IS NOT NULL), r AS (
SELECT vec_id, 0 AS ord, 'top_left' AS region, v, lap FROM i WHERE y < 4 AND x < 4 UNION ALL SELECT vec_id, 1, 'top_right', v, lap FROM i WHERE y < 4 AND x >= 4 UNION ALL SELECT vec_id, 2, 'bottom_left', v, lap FROM i WHERE y >= 4 AND x < 4
UNION ALL SELECT vec_id, 3, 'bottom_right', v, lap FROM i WHERE y >= 4 AND x >= 4 UNION ALL SELECT vec_id, 4, 'centre', v, lap FROM i WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5),
s AS (SELECT vec_id, ord, region, var_pop(lap) / pow(avg(v + 1) + 1e-6, 2) AS score FROM r GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9), ord) AS n FROM s) SELECT vec_id, region, round(score, 6) AS score FROM n WHERE n = 1""")
_BOX = lambda f, k, v="v": f"SELECT c.vec_id, c.y, c.x, {f}(o.{v}) AS v FROM g c JOIN e o ON o.vec_id = c.vec_id AND o.y BETWEEN c.y - {k} AND c.y + {k} AND o.x BETWEEN c.x - {k} AND c.x + {k} GROUP BY c.vec_id, c.y, c.x"
_add("box_contrast_grid", lambda s, d: rounded(X.local_contrast(grid(s, d), "vec_id", 8, 8, 3), "contrast"),
     f"WITH {GRID_SQL}, {_PAD.format(k=1)}, b AS (SELECT c.vec_id, c.y, c.x, avg(o.v) AS m, avg(o.v * o.v) AS q FROM g c JOIN e o ON o.vec_id = c.vec_id AND o.y BETWEEN c.y - 1 AND c.y + 1 AND o.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY c.vec_id, c.y, c.x) SELECT vec_id, round(avg(sqrt(greatest(q - m * m, 0))), 6) AS contrast FROM b GROUP BY vec_id")
_add("dilate_grid", lambda s, d: rounded(longs(X.box(grid(s, d), "vec_id", 8, 8, 3, F.max), "y", "x"), "v"), f"WITH {GRID_SQL}, {_PAD.format(k=1)}, b AS ({_BOX('max', 1)}) SELECT vec_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(v, 6) AS v FROM b")
_add("erode_grid", lambda s, d: rounded(longs(X.box(grid(s, d), "vec_id", 8, 8, 3, F.min), "y", "x"), "v"), f"WITH {GRID_SQL}, {_PAD.format(k=1)}, b AS ({_BOX('min', 1)}) SELECT vec_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(v, 6) AS v FROM b")
_add("median_grid", lambda s, d: rounded(longs(X.median(grid(s, d), "vec_id", 3), "y", "x"), "v"), f"WITH {GRID_SQL}, e AS (SELECT * FROM g), b AS ({_BOX('median', 1)}) SELECT vec_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(v, 6) AS v FROM b")
_add("percentile_mask", lambda s, d: X.above_percentile(grid(s, d), "vec_id", 0.92).groupBy("vec_id").agg(F.sum(F.col("hit").cast("long")).alias("n_hit")), f"WITH {GRID_SQL}, q AS (SELECT vec_id, quantile_cont(v, 0.92) AS t FROM g GROUP BY 1) SELECT vec_id, CAST(sum(CASE WHEN v > t THEN 1 ELSE 0 END) AS BIGINT) AS n_hit FROM g JOIN q USING (vec_id) GROUP BY vec_id")
_add("otsu", lambda s, d: rounded(X.otsu(grid(s, d).withColumn("v", coerce.clip(F.col("v") + 0.5, 0.0, 1.0)), "vec_id", 32), "threshold"),
     f"""WITH {GRID_SQL}, h AS (SELECT vec_id, CAST(least(floor(least(greatest(v + 0.5::DOUBLE, 0.0), 1.0) * 32), 31) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY 1, 2),
c AS (SELECT vec_id, bin, sum(n) OVER w AS w, sum(n * (bin + 0.5::DOUBLE) / 32) OVER w AS s, sum(n) OVER (PARTITION BY vec_id) AS tw, sum(n * (bin + 0.5::DOUBLE) / 32) OVER (PARTITION BY vec_id) AS ts FROM h WINDOW w AS (PARTITION BY vec_id ORDER BY bin)),
b AS (SELECT vec_id, bin, coalesce(round((ts * w - s * tw) * (ts * w - s * tw) / nullif(w * (tw - w), 0), 9), 0.0) AS between_var FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY between_var DESC, bin) AS n FROM b) SELECT vec_id, round((bin + 0.5::DOUBLE) / 32, 6) AS threshold FROM r WHERE n = 1""")
_add("plane_fit", lambda s, d: rounded(X.plane(grid(s, d), "vec_id"), "slope_x", "slope_y", "tilt"), f"WITH {GRID_SQL}, f AS (SELECT vec_id, regr_slope(v, x) AS a, regr_slope(v, y) AS b FROM g GROUP BY vec_id) SELECT vec_id, round(a, 6) AS slope_x, round(b, 6) AS slope_y, round(sqrt(a * a + b * b), 6) AS tilt FROM f")
_add("circle_fit", lambda s, d: rounded(X.circle(grid(s, d).filter("v > 0.1"), "vec_id"), "cx", "cy", "r", digits=4),
     f"""WITH {GRID_SQL}, k AS (SELECT vec_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM g WHERE v > 0.1::DOUBLE), m AS (SELECT *, x - avg(x) OVER (PARTITION BY vec_id) AS u, y - avg(y) OVER (PARTITION BY vec_id) AS w FROM k),
s AS (SELECT vec_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(u*u) AS uu, sum(u*w) AS uw, sum(w*w) AS ww, sum(u*(u*u+w*w)) AS ur, sum(w*(u*u+w*w)) AS wr FROM m GROUP BY vec_id),
c AS (SELECT *, (ur*ww - wr*uw) / nullif(2*(uu*ww - uw*uw), 0) AS cu, (wr*uu - ur*uw) / nullif(2*(uu*ww - uw*uw), 0) AS cw FROM s) SELECT vec_id, round(mx + cu, 4) AS cx, round(my + cw, 4) AS cy, round(sqrt(cu*cu + cw*cw + (uu+ww)/n), 4) AS r FROM c""")
_add("radial_slope", lambda s, d: rounded(grid(s, d).withColumn("r", F.hypot(F.col("x") - 3.5, F.col("y") - 3.5)).groupBy("vec_id").agg(F.regr_slope("v", "r").alias("slope")), "slope"), f"WITH {GRID_SQL} SELECT vec_id, round(regr_slope(v, sqrt((x - 3.5::DOUBLE) * (x - 3.5::DOUBLE) + (y - 3.5::DOUBLE) * (y - 3.5::DOUBLE))), 6) AS slope FROM g GROUP BY vec_id")
_add("view_mask", lambda s, d: rounded(longs(X.view_mask(grid(s, d).withColumn("lit", F.col("v") > 0.05), "vec_id"), "pixels", "cy", "cx"), "rh", "rv"),
     f"""WITH {GRID_SQL}, k AS (SELECT * FROM g WHERE v > 0.05::DOUBLE), c AS (SELECT vec_id, count(*) AS pixels, CAST(round_even(avg(y), 0) AS BIGINT) AS cy, CAST(round_even(avg(x), 0) AS BIGINT) AS cx FROM k GROUP BY 1)
SELECT i.vec_id, coalesce(any_value(pixels), 0) AS pixels, any_value(cy) AS cy, any_value(cx) AS cx, coalesce((max(x) FILTER (y = cy) - min(x) FILTER (y = cy)) / 2.0::DOUBLE, 0.0) AS rh, coalesce((max(y) FILTER (x = cx) - min(y) FILTER (x = cx)) / 2.0::DOUBLE, 0.0) AS rv FROM embeddings i LEFT JOIN c USING (vec_id) LEFT JOIN k USING (vec_id) GROUP BY i.vec_id""")


def _kernel_sql(kernels) -> str:
    rows = ", ".join(f"({i}, {dy}, {dx}, {w!r}::DOUBLE)" for i, k in enumerate(kernels) for (dy, dx), w in sorted(k.items()))
    return f"t(k, dy, dx, w) AS (VALUES {rows}), r AS (SELECT c.vec_id, c.y, c.x, k, sum(o.v * w) AS v FROM g c, t JOIN g o ON o.vec_id = c.vec_id AND o.y = c.y + dy AND o.x = c.x + dx GROUP BY ALL)"


_LINES = [X.line_kernel(5, math.pi * k / 4) for k in range(4)]
_FILTERS = [X.matched_kernel(math.pi * k / 4, 1.0, 3) for k in range(4)]
_add("line_response_grid", lambda s, d: rounded(X.strongest_rows(table(s, d, "embeddings"), "vec_id", 8, "embedding", _LINES).groupBy("vec_id").agg(F.avg("v").alias("mean"), F.max("v").alias("top")), "mean", "top"), f"WITH {GRID_SQL}, {_kernel_sql(_LINES)}, b AS (SELECT vec_id, y, x, max(v) AS v FROM r GROUP BY 1, 2, 3) SELECT vec_id, round(avg(v), 6) AS mean, round(max(v), 6) AS top FROM b GROUP BY vec_id")
_add("matched_filter_grid", lambda s, d: rounded(X.strongest_rows(table(s, d, "embeddings"), "vec_id", 8, "embedding", _FILTERS).groupBy("vec_id").agg(F.avg("v").alias("mean"), F.max("v").alias("top")), "mean", "top"), f"WITH {GRID_SQL}, {_kernel_sql(_FILTERS)}, b AS (SELECT vec_id, y, x, max(v) AS v FROM r GROUP BY 1, 2, 3) SELECT vec_id, round(avg(v), 6) AS mean, round(max(v), 6) AS top FROM b GROUP BY vec_id")
_add("spectral_slope", lambda s, d: rounded(X.spectral_slope(grid(s, d), "vec_id", 8), "slope", digits=4),
     f"""WITH {GRID_SQL}, m AS (SELECT vec_id, y, x, (v - avg(v) OVER (PARTITION BY vec_id)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * y / 7)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * x / 7)) AS f FROM g),
w AS (SELECT vec_id, a, b, pow(sum(f * cos((a * y + b * x) * 2 * pi() / 8)), 2) + pow(sum(f * sin((a * y + b * x) * 2 * pi() / 8)), 2) AS p FROM m, range(-4, 4) t(a), range(-4, 4) u(b) GROUP BY vec_id, a, b),
r AS (SELECT vec_id, floor(sqrt(CAST(a * a + b * b AS DOUBLE))) AS r, avg(p) AS p FROM w GROUP BY 1, 2) SELECT vec_id, round(coalesce(regr_slope(ln(p), ln(r)), 0.0), 4) AS slope FROM r WHERE r >= 1 AND p > 0 GROUP BY vec_id""")
_add("calibre_shares", lambda s, d: rounded(grid(s, d).groupBy("vec_id").agg(*((100.0 * F.avg((F.floor(F.abs("v") * 10) == k).cast("double"))).alias(f"pct{k}") for k in range(4))), *(f"pct{k}" for k in range(4))), f"WITH {GRID_SQL} SELECT vec_id, " + ", ".join(f"round(100.0 * avg(CASE WHEN floor(abs(v) * 10) = {k} THEN 1.0 ELSE 0.0 END), 6) AS pct{k}" for k in range(4)) + " FROM g GROUP BY vec_id")
_QUAD = "CAST(least(floor((CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END) / (pi() / 2)), 3) AS INTEGER)"
_add("quadrant_counts", lambda s, d: X.above_percentile(grid(s, d), "vec_id", 0.8).filter("hit").select("vec_id", X.quadrant(F.col("x"), F.col("y"), F.lit(0.3), 3.4, 3.6).alias("q")).groupBy("vec_id").agg(*(F.sum((F.col("q") == k).cast("long")).alias(f"q{k + 1}") for k in range(4))),
     f"WITH {GRID_SQL}, p AS (SELECT vec_id, quantile_cont(v, 0.8) AS t FROM g GROUP BY 1), a AS (SELECT g.vec_id, atan2(y - 3.6::DOUBLE, x - 3.4::DOUBLE) - 0.3::DOUBLE AS a FROM g JOIN p USING (vec_id) WHERE v > t), q AS (SELECT vec_id, {_QUAD} AS q FROM a) SELECT vec_id, " + ", ".join(f"CAST(sum(CASE WHEN q = {k} THEN 1 ELSE 0 END) AS BIGINT) AS q{k + 1}" for k in range(4)) + " FROM q GROUP BY vec_id")
_add("components_grid", lambda s, d: N.components(grid(s, d).withColumn("hit", F.col("v") > 0.08), "vec_id", "hit").groupBy("vec_id").agg(F.countDistinct("component").alias("n"), F.count("*").alias("pixels")),
     f"WITH RECURSIVE {GRID_SQL}, k AS (SELECT vec_id, y, x FROM g WHERE v > 0.08::DOUBLE), c AS (SELECT vec_id, y, x, y * 8 + x AS r FROM k UNION SELECT k.vec_id, k.y, k.x, c.r FROM c JOIN k ON k.vec_id = c.vec_id AND abs(k.y - c.y) + abs(k.x - c.x) = 1), m AS (SELECT vec_id, y, x, min(r) AS r FROM c GROUP BY 1, 2, 3) SELECT vec_id, count(DISTINCT r) AS n, count(*) AS pixels FROM m GROUP BY vec_id")
_add("components8_grid", lambda s, d: N.components(grid(s, d).withColumn("hit", F.col("v") > 0.1), "vec_id", "hit", 8).groupBy("vec_id", "component").agg(F.count("*").alias("n")).groupBy("vec_id").agg(F.count("*").alias("parts"), F.max("n").alias("largest")),
     f"WITH RECURSIVE {GRID_SQL}, k AS (SELECT vec_id, y, x FROM g WHERE v > 0.1::DOUBLE), c AS (SELECT vec_id, y, x, y * 8 + x AS r FROM k UNION SELECT k.vec_id, k.y, k.x, c.r FROM c JOIN k ON k.vec_id = c.vec_id AND greatest(abs(k.y - c.y), abs(k.x - c.x)) = 1), m AS (SELECT vec_id, y, x, min(r) AS r FROM c GROUP BY 1, 2, 3), z AS (SELECT vec_id, r, count(*) AS n FROM m GROUP BY 1, 2) SELECT vec_id, count(*) AS parts, max(n) AS largest FROM z GROUP BY vec_id")
_add("edt_grid", lambda s, d: rounded(X.nearest_distance(grid(s, d).filter("v > 0"), grid(s, d).filter("v <= 0"), "vec_id").groupBy("vec_id").agg(F.avg("distance").alias("mean"), F.max("distance").alias("top")), "mean", "top"),
     f"WITH {GRID_SQL}, e AS (SELECT a.vec_id, a.y, a.x, min(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS dd FROM g a LEFT JOIN g b ON b.vec_id = a.vec_id AND b.v <= 0 WHERE a.v > 0 GROUP BY 1, 2, 3) SELECT vec_id, round(avg(dd), 6) AS mean, round(max(dd), 6) AS top FROM e GROUP BY vec_id")


def _lengths(s, d):
    px = grid(s, d).withColumn("hit", F.col("v") > 0.05)
    parts = N.components(px, "vec_id", "hit")
    far = X.nearest_distance(px.filter("hit"), px.filter("not hit"), "vec_id")
    rows = parts.join(far, ["vec_id", "y", "x"]).groupBy("vec_id", "component").agg(F.count("*").alias("area"), F.avg("distance").alias("w"))
    return rounded(rows.groupBy("vec_id").agg(F.sum(F.col("area") / (4 * F.col("w"))).alias("length")), "length")


_add("component_length", _lengths,
     f"""WITH RECURSIVE {GRID_SQL}, k AS (SELECT vec_id, y, x FROM g WHERE v > 0.05::DOUBLE), c AS (SELECT vec_id, y, x, y * 8 + x AS r FROM k UNION SELECT k.vec_id, k.y, k.x, c.r FROM c JOIN k ON k.vec_id = c.vec_id AND abs(k.y - c.y) + abs(k.x - c.x) = 1), m AS (SELECT vec_id, y, x, min(r) AS r FROM c GROUP BY 1, 2, 3),
e AS (SELECT k.vec_id, k.y, k.x, min(sqrt((k.y - b.y) * (k.y - b.y) + (k.x - b.x) * (k.x - b.x))) AS dd FROM k JOIN g b ON b.vec_id = k.vec_id AND b.v <= 0.05::DOUBLE GROUP BY 1, 2, 3), z AS (SELECT vec_id, r, count(*) AS area, avg(dd) AS w FROM m JOIN e USING (vec_id, y, x) GROUP BY 1, 2) SELECT vec_id, round(sum(area / (4 * w)), 6) AS length FROM z GROUP BY vec_id""")
_add("hole_fill_grid", lambda s, d: N.filled(grid(s, d).withColumn("hit", F.col("v") > -0.05), "vec_id", "hit").groupBy("vec_id").agg(F.sum(F.col("hit").cast("long")).alias("pixels")),
     f"WITH RECURSIVE {GRID_SQL}, k AS (SELECT vec_id, y, x FROM g WHERE v <= -0.05::DOUBLE), c AS (SELECT vec_id, y, x FROM k WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT k.vec_id, k.y, k.x FROM c JOIN k ON k.vec_id = c.vec_id AND abs(k.y - c.y) + abs(k.x - c.x) = 1), z AS (SELECT vec_id, count(*) AS n FROM c GROUP BY 1) SELECT vec_id, CAST(64 - coalesce(n, 0) AS BIGINT) AS pixels FROM embeddings LEFT JOIN z USING (vec_id)")
_add("kernel_statistics", lambda s, d: rounded(N.image_statistics(grid(s, d), "vec_id"), "vesselness", "scale", "closing_gap", "contrast"))


def _images(s, d):
    return table(s, d, "embeddings").select("vec_id", F.lit(3.0).alias("od_x"), F.lit(3.0).alias("od_y"), F.lit(5.0).alias("fovea_x"), F.lit(4.0).alias("fovea_y"), (F.col("label") % 3).alias("venous_beading_quadrants"), (F.col("label") % 2).alias("nv_irma_quadrants"))


def _kept(s, d):
    px = X.above_percentile(grid(s, d), "vec_id", 0.7).filter("hit")
    lesion = F.element_at(F.array(*map(F.lit, L.LESIONS)), ((F.col("y") + F.col("x")) % 4 + 1).cast("int"))
    return px.select("vec_id", lesion.alias("lesion"), F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), (F.col("y") + 1.0).alias("area"))


_SIGNS = ["haem_q_min", "haem_q_max", "rule421_haem", "rule421_beading", "rule421_irma", "severe_npdr_flag"]
_LESION_COLUMNS = ["haem_count", "ma_count", "hard_exudate_count", "cws_count", "haem_q1", "haem_q4", "haem_q_min", "haem_q_max", "rule421_haem", "severe_npdr_flag", "dme_flag"]
_add("lesion_rows", lambda s, d: rounded(longs(L.image_rows(_images(s, d), _kept(s, d), "vec_id", 64.0).select("vec_id", *_LESION_COLUMNS, "hard_exudate_area_pct", "exudate_fovea_min_dist_dd"), *_LESION_COLUMNS), "hard_exudate_area_pct", "exudate_fovea_min_dist_dd"),
     f"""WITH {GRID_SQL}, p AS (SELECT vec_id, quantile_cont(v, 0.7) AS t FROM g GROUP BY 1), k AS (SELECT g.vec_id, y, x, (y + x) % 4 AS le, atan2(y - 3.0::DOUBLE, x - 3.0::DOUBLE) - atan2(1.0::DOUBLE, 2.0::DOUBLE) AS a FROM g JOIN p USING (vec_id) WHERE v > t),
q AS (SELECT *, {_QUAD} AS q FROM k), c AS (SELECT vec_id, count(*) FILTER (le = 1) AS haem_count, count(*) FILTER (le = 0) AS ma_count, count(*) FILTER (le = 2) AS hard_exudate_count, count(*) FILTER (le = 3) AS cws_count,
count(*) FILTER (le = 1 AND q = 0) AS q1, count(*) FILTER (le = 1 AND q = 1) AS q2, count(*) FILTER (le = 1 AND q = 2) AS q3, count(*) FILTER (le = 1 AND q = 3) AS q4, sum(y + 1.0) FILTER (le = 2) AS ar, min(sqrt((x - 5) * (x - 5) + (y - 4) * (y - 4))) FILTER (le = 2) / 124.0::DOUBLE AS dd FROM q GROUP BY vec_id)
SELECT c.vec_id, haem_count, ma_count, hard_exudate_count, cws_count, q1 AS haem_q1, q4 AS haem_q4, least(q1, q2, q3, q4) AS haem_q_min, greatest(q1, q2, q3, q4) AS haem_q_max, CAST(CASE WHEN least(q1, q2, q3, q4) > 3 THEN 1 ELSE 0 END AS BIGINT) AS rule421_haem,
CAST(CASE WHEN least(q1, q2, q3, q4) > 3 OR label % 3 >= 2 OR label % 2 >= 1 THEN 1 ELSE 0 END AS BIGINT) AS severe_npdr_flag, CAST(CASE WHEN hard_exudate_count > 0 THEN 1 ELSE 0 END AS BIGINT) AS dme_flag, round(100.0::DOUBLE * coalesce(ar, 0) / 64, 6) AS hard_exudate_area_pct, round(coalesce(dd, 2 * 436 * sqrt(2.0::DOUBLE) / 124), 6) AS exudate_fovea_min_dist_dd FROM c JOIN embeddings USING (vec_id)""")
_QUADRANT_COUNTS = "SELECT vec_id, haem_q_min, haem_q_max, rule421_haem, CAST(CASE WHEN label % 3 >= 2 THEN 1 ELSE 0 END AS BIGINT) AS rule421_beading, CAST(CASE WHEN label % 2 >= 1 THEN 1 ELSE 0 END AS BIGINT) AS rule421_irma, severe_npdr_flag"
_add("rule_421", lambda s, d: longs(L.image_rows(_images(s, d), _kept(s, d), "vec_id", 64.0).select("vec_id", *_SIGNS), *_SIGNS), f"{_QUADRANT_COUNTS} FROM ({ORACLES['lesion_rows']}) JOIN embeddings USING (vec_id)")
_add("dme_flag", lambda s, d: rounded(longs(L.image_rows(_images(s, d), _kept(s, d), "vec_id", 64.0).select("vec_id", "hard_exudate_count", "exudate_fovea_min_dist_dd", "dme_flag"), "hard_exudate_count", "dme_flag"), "exudate_fovea_min_dist_dd"), f"SELECT vec_id, hard_exudate_count, exudate_fovea_min_dist_dd, dme_flag FROM ({ORACLES['lesion_rows']})")
_add("minmax_placeholder", lambda s, d: rounded(L.placeholder_score(table(s, d, "lineitem"), ["l_orderkey"], ["l_quantity", "l_extendedprice", "l_discount"]).select("l_orderkey", "l_linenumber", "l_partkey", "score"), "score"),
     "SELECT l_orderkey, l_linenumber, l_partkey, round(((l_quantity - min(l_quantity) OVER w) / greatest(max(l_quantity) OVER w - min(l_quantity) OVER w, 1e-6) + (l_extendedprice - min(l_extendedprice) OVER w) / greatest(max(l_extendedprice) OVER w - min(l_extendedprice) OVER w, 1e-6) + (l_discount - min(l_discount) OVER w) / greatest(max(l_discount) OVER w - min(l_discount) OVER w, 1e-6)) / 3, 6) AS score FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
_add("select_threshold", lambda s, d: L.select_threshold(table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") / 100.0).alias("score")), table(s, d, "orders").filter("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("k")), "k", "score"),
     "WITH t AS (SELECT round(k * 0.05::DOUBLE, 2) AS t FROM range(1, 20) r(k)), i AS (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'), c AS (SELECT o_orderkey, t, count(*) FILTER (l_quantity / 100.0::DOUBLE >= t) AS n FROM i CROSS JOIN t LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), m AS (SELECT t, median(n) AS m FROM c GROUP BY t) SELECT coalesce(min(t) FILTER (m = 0), 0.95) AS threshold FROM m")


def _photo(values):
    """An image about 128, the grid drawn larger: each value is the shade of 4 x 4 pixels."""
    v = values.astype(float).reshape(-1, 8).repeat(4, 0).repeat(4, 1)
    y, x = np.indices(v.shape)
    shade = 128 + 200 * v + ((y % 4 * 4 + x % 4) * 7) % 5
    return (np.where(np.isnan(shade), 255.0, np.clip(shade, 0.0, 255.0)),)


def _photos(s, d):
    """(vec_id, v): images of 32 x 32 as one array a row, dealt over all cores, as drawing and measuring take far longer than moving embeddings."""
    return P.drawn(table(s, d, "embeddings").repartition(s.sparkContext.defaultParallelism, "vec_id"), ["vec_id"], "embedding", ["v"], _photo)


_add("landmarks", lambda s, d: rounded(A.landmark_rows(_photos(s, d), "vec_id", 32, 16.0, 4.0, (16.0, 16.0), 2), "contrast", "y", "x", "darkness", digits=4))
_add("enhancement_choice", lambda s, d: A.enhancement_choice(A.enhancement_attempt_rows(_photos(s, d), "vec_id", 32), "vec_id"))
_add("lesion_candidates", lambda s, d: rounded(A.lesion_candidate_rows(_photos(s, d), "vec_id", 32, 15, 96.0, 3, 900), *A.CANDIDATE_FEATURES, digits=4))
_add("lesion_evidence", lambda s, d: rounded(longs(A.evidence(_kept(s, d), "vec_id", {"ma": 0.8, "haem": 1.0, "hard_exudate": 0.6, "cws": 0.6}), "y", "x"), "weight"),
     f"""WITH {GRID_SQL}, p AS (SELECT vec_id, quantile_cont(v, 0.7) AS t FROM g GROUP BY 1), k AS (SELECT g.vec_id, y, x, (y + 1) * CASE (y + x) % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 ELSE 0.6 END AS w FROM g JOIN p USING (vec_id) WHERE v > t)
SELECT vec_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(CAST(w AS DOUBLE) / max(CAST(w AS DOUBLE)) OVER (PARTITION BY vec_id), 6) AS weight FROM k""")
