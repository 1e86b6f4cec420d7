"""Queries of kernels on image arrays: vessel map, lesion candidates, bridged gaps, fields of view.

Images are drawn from embeddings: shades are their values, and lines, spots and discs lie where values put them.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import first_stage as A
from ..operators import focus as O
from ..operators import gates as G
from ..operators import images as I
from ..operators import kernels as N
from ..operators import landmarks as M
from ..operators import lesion as L
from ..operators import spots as S
from ..operators import summaries as U
from ..operators import traits as T
from ..operators import vessels as V
from ..operators import view as W
from ..sources import tables
from .inputs import GRID_SQL, grid, rounded, table

QUERIES, ORACLES = {}, {}

SIZE = 64
#: The vessel map's sizes for a retina of 32 pixels' radius.
SMALL = V.Scale(matched_sigma=1.0, matched_length=5, sigmas=(1.0, 1.5, 2.0, 3.0), fine=(5, 7), coarse=(15, 15), coarse_dilation=3, disc_diameter=18, least_in_quadrant=2)
#: Both scales of lines on 8 x 8 grids.
TINY = V.Scale(orientations=4, fine=(3, 3), coarse=(5, 5), excess_percentile=80.0, coarse_dilation=3)
GAP = 3
GAP_ABOVE = 0.12


@cache
def _places(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and number of each pixel."""
    y, x = np.indices((size, size))
    return y, x, y * size + x


def _levels(image: np.ndarray) -> np.ndarray:
    """Whole levels 0..255; what is no number counts as the largest."""
    return np.floor(np.fmax(0, np.fmin(255, image)))


def _dealt(s, d):
    """Embeddings over all cores; drawing and measuring take far longer than moving them."""
    return table(s, d, "embeddings").repartition(s.sparkContext.defaultParallelism, "vec_id")


def _eye(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, x, p = _places(SIZE)
    e, grain = e.astype(np.float64), p * 7 % 5
    at = (y // 8) * 8 + x // 8
    one = 70 * np.exp(-((x - 20 - 60 * e[y // 8]) ** 2) / 3)
    other = 50 * np.exp(-((y - 44 + 30 * e[8 + x // 8] - 2 * x / 10) ** 2) / 2)
    spot = 60 * np.exp(-((x - 40 - 40 * e[1]) ** 2 + (y - 16 - 40 * e[2]) ** 2) / 5)
    return _levels(170 + 40 * e[at] + grain), _levels(130 + 80 * e[at] - one + other - spot + grain), _levels(90 + 200 * e[63 - at] - 0.5 * (one + other) + grain)


def eyes(s, d):
    """(vec_id, red, green, blue, od_x, od_y, od_radius, fovea_x, fovea_y): square images of levels 0..255."""
    marks = {"od_x": 14.0, "od_y": 30.0, "od_radius": 5.0, "fovea_x": 36.0, "fovea_y": 33.0}
    return I.drawn(_dealt(s, d), ["vec_id"], "embedding", ["red", "green", "blue"], _eye).withColumns({c: F.lit(v) for c, v in marks.items()})


_SHARES = [c for c in V.VESSEL_COLUMNS if c not in V._WHOLE]
QUERIES["vessel_map"] = lambda s, d: rounded(V.vessel_rows(eyes(s, d), "vec_id", SIZE, SMALL), *_SHARES)
QUERIES["lesion_spots"] = lambda s, d: rounded(S.candidate_rows(eyes(s, d), "vec_id", SIZE, SMALL), "cx", "cy")
QUERIES["candidate_features"] = lambda s, d: rounded(T.candidate_rows(eyes(s, d), "vec_id", SIZE, SMALL), "cx", "cy", *T.FEATURES)

PART_ABOVE = 0.05
QUERIES["part_shapes"] = lambda s, d: rounded(T.shape_rows(table(s, d, "embeddings"), "vec_id", 8, "embedding", PART_ABOVE).select("vec_id", "part", "area", "perimeter"), "perimeter")
ORACLES["part_shapes"] = f"""WITH RECURSIVE {GRID_SQL}, m AS (SELECT vec_id, y, x FROM g WHERE v > {PART_ABOVE}::DOUBLE),
c AS (SELECT vec_id, y, x, y * 8 + x AS r FROM m UNION SELECT m.vec_id, m.y, m.x, c.r FROM c JOIN m ON m.vec_id = c.vec_id AND abs(m.y - c.y) <= 1 AND abs(m.x - c.x) <= 1),
k AS (SELECT vec_id, y, x, min(r) AS r FROM c GROUP BY ALL),
f AS (SELECT p.vec_id, p.r, CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, k.r IS NOT NULL AS own FROM (SELECT DISTINCT vec_id, r FROM k) p, range(-1, 9) a(y), range(-1, 9) b(x) LEFT JOIN k ON k.vec_id = p.vec_id AND k.r = p.r AND k.y = a.y AND k.x = b.x),
o AS (SELECT vec_id, r, -1 AS y, -1 AS x FROM f WHERE y = -1 AND x = -1 UNION SELECT f.vec_id, f.r, f.y, f.x FROM o JOIN f ON f.vec_id = o.vec_id AND f.r = o.r AND abs(f.y - o.y) + abs(f.x - o.x) = 1 AND NOT f.own),
w AS (SELECT f.vec_id, f.r, f.y, f.x, CASE WHEN o.r IS NULL THEN 1 ELSE 0 END AS i FROM f LEFT JOIN o ON o.vec_id = f.vec_id AND o.r = f.r AND o.y = f.y AND o.x = f.x),
q AS (SELECT a.vec_id, a.r, a.i + b.i + c.i + d.i AS n, a.i = d.i AS across FROM w a JOIN w b ON b.vec_id = a.vec_id AND b.r = a.r AND b.y = a.y AND b.x = a.x + 1
  JOIN w c ON c.vec_id = a.vec_id AND c.r = a.r AND c.y = a.y + 1 AND c.x = a.x JOIN w d ON d.vec_id = a.vec_id AND d.r = a.r AND d.y = a.y + 1 AND d.x = a.x + 1),
b AS (SELECT vec_id, r, count(CASE WHEN n = 2 AND NOT across THEN 1 END) AS straight, count(CASE WHEN n = 3 THEN 1 END) + 2 * count(CASE WHEN n = 2 AND across THEN 1 END) AS slanted FROM q GROUP BY ALL),
z AS (SELECT vec_id, r, count(*) AS area FROM k GROUP BY ALL)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY r) AS INTEGER) AS part, area, round(CASE WHEN straight + slanted < 3 THEN 0 ELSE straight + slanted * sqrt(2.0::DOUBLE) END, 6) AS perimeter FROM z JOIN b USING (vec_id, r)"""


def _lines_sql(name: str, size: tuple[int, int]) -> str:
    """Best line answer of mirrored 8 x 8 grids, less the mean of a square."""
    length, width = size
    rows = []
    for k in range(TINY.orientations):
        line = P.rotated_line(length, 180.0 * k / TINY.orientations)
        line = line / line.sum()
        rows += [f"({k}, {y - length // 2}, {x - length // 2}, {line[y, x].item()!r}::DOUBLE)" for y in range(length) for x in range(length) if line[y, x]]
    half = width // 2
    return f"""t{name}(k, dy, dx, w) AS (VALUES {", ".join(rows)}),
l{name} AS (SELECT vec_id, y, x, round(max(v), 9) AS v FROM (SELECT c.vec_id, c.y, c.x, k, sum(w * (1 - o.v)) AS v FROM g c, t{name} JOIN e o ON o.vec_id = c.vec_id AND o.y = c.y + dy AND o.x = c.x + dx GROUP BY ALL) GROUP BY ALL),
b{name} AS (SELECT c.vec_id, c.y, c.x, round(avg(1 - o.v), 9) AS v FROM g c JOIN e o ON o.vec_id = c.vec_id AND o.y BETWEEN c.y - {half} AND c.y + {half} AND o.x BETWEEN c.x - {half} AND c.x + {half} GROUP BY ALL),
a{name} AS (SELECT l.vec_id, l.y, l.x, l.v - b.v AS v FROM l{name} l JOIN b{name} b USING (vec_id, y, x)),
s{name} AS (SELECT a.vec_id, a.y, a.x FROM a{name} a JOIN (SELECT vec_id, quantile_cont(v, 0.8) AS cut FROM a{name} GROUP BY vec_id) q USING (vec_id) WHERE a.v > cut)"""


_MIRROR = "e AS (SELECT vec_id, py AS y, px AS x, v FROM range(-2, 10) a(py), range(-2, 10) b(px) JOIN g ON g.y = (CASE WHEN py < 0 THEN -py WHEN py > 7 THEN 14 - py ELSE py END) AND g.x = (CASE WHEN px < 0 THEN -px WHEN px > 7 THEN 14 - px ELSE px END))"
QUERIES["line_excess_grid"] = lambda s, d: V.excess_rows(table(s, d, "embeddings"), "vec_id", 8, TINY, "embedding")
ORACLES["line_excess_grid"] = f"""WITH {GRID_SQL}, {_MIRROR}, {_lines_sql("f", TINY.fine)}, {_lines_sql("c", TINY.coarse)},
n AS (SELECT f.* FROM sf f LEFT JOIN sc c ON c.vec_id = f.vec_id AND abs(c.y - f.y) <= 1 AND abs(c.x - f.x) <= 1 WHERE c.vec_id IS NULL)
SELECT i.vec_id, count(n.y) AS n_excess, CAST(coalesce(sum(n.y), 0) AS BIGINT) AS y_sum, CAST(coalesce(sum(n.x), 0) AS BIGINT) AS x_sum FROM embeddings i LEFT JOIN n USING (vec_id) GROUP BY i.vec_id"""


def _supports_sql() -> str:
    rows = set()
    for k in range(S.ORIENTATIONS):
        support = P.line_support(GAP, 180.0 * k / S.ORIENTATIONS)
        rows |= {(k, y - GAP // 2, x - GAP // 2) for y in range(GAP) for x in range(GAP) if support[y, x]}
    return f"s(k, dy, dx) AS (VALUES {', '.join(map(str, sorted(rows)))})"


QUERIES["bridge_gaps"] = lambda s, d: S.bridge_rows(table(s, d, "embeddings"), "vec_id", 8, GAP, "embedding", GAP_ABOVE)
ORACLES["bridge_gaps"] = f"""WITH RECURSIVE {GRID_SQL}, {_supports_sql()}, m AS (SELECT vec_id, y, x FROM g WHERE v > {GAP_ABOVE}::DOUBLE),
cm AS (SELECT vec_id, y, x, y * 8 + x AS r FROM m UNION SELECT m.vec_id, m.y, m.x, c.r FROM cm c JOIN m ON m.vec_id = c.vec_id AND abs(m.y - c.y) + abs(m.x - c.x) = 1),
pm AS (SELECT vec_id, y, x, min(r) AS r FROM cm GROUP BY ALL),
dil AS (SELECT DISTINCT g.vec_id, k, g.y, g.x FROM g, s JOIN m ON m.vec_id = g.vec_id AND m.y = g.y + dy AND m.x = g.x + dx),
ero AS (SELECT g.vec_id, s.k, g.y, g.x FROM g, s LEFT JOIN dil d ON d.vec_id = g.vec_id AND d.k = s.k AND d.y = g.y + dy AND d.x = g.x + dx WHERE g.y + dy BETWEEN 0 AND 7 AND g.x + dx BETWEEN 0 AND 7 GROUP BY ALL HAVING count(*) = count(d.y)),
ad AS (SELECT DISTINCT vec_id, y, x FROM ero EXCEPT SELECT vec_id, y, x FROM m),
ca AS (SELECT vec_id, y, x, y * 8 + x AS r FROM ad UNION SELECT a.vec_id, a.y, a.x, c.r FROM ca c JOIN ad a ON a.vec_id = c.vec_id AND abs(a.y - c.y) + abs(a.x - c.x) = 1),
pa AS (SELECT vec_id, y, x, min(r) AS r FROM ca GROUP BY ALL),
seen AS (SELECT a.vec_id, a.r, a.y, a.x, max(p.r) AS part FROM pa a JOIN pm p ON p.vec_id = a.vec_id AND abs(p.y - a.y) <= 1 AND abs(p.x - a.x) <= 1 GROUP BY ALL),
ok AS (SELECT vec_id, r FROM seen GROUP BY ALL HAVING count(DISTINCT part) >= 2),
o AS (SELECT vec_id, y, x FROM m UNION SELECT a.vec_id, a.y, a.x FROM pa a JOIN ok USING (vec_id, r)),
co AS (SELECT vec_id, y, x, y * 8 + x AS r FROM o UNION SELECT o.vec_id, o.y, o.x, c.r FROM co c JOIN o ON o.vec_id = c.vec_id AND abs(o.y - c.y) + abs(o.x - c.x) = 1),
po AS (SELECT vec_id, y, x, min(r) AS r FROM co GROUP BY ALL)
SELECT i.vec_id, coalesce(a.n, 0) AS pixels, coalesce(b.n, 0) - coalesce(a.n, 0) AS added, coalesce(a.parts, 0) AS parts_before, coalesce(b.parts, 0) AS parts_after FROM embeddings i
LEFT JOIN (SELECT vec_id, count(*) AS n, count(DISTINCT r) AS parts FROM pm GROUP BY 1) a USING (vec_id) LEFT JOIN (SELECT vec_id, count(*) AS n, count(DISTINCT r) AS parts FROM po GROUP BY 1) b USING (vec_id)"""


def _disc(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y, x, _ = _places(SIZE)
    e = e.astype(np.float64)
    inside = np.hypot(x - 32 - 40 * e[1], y - 32 - 40 * e[2]) < 20 + 40 * e[3] + 12 * np.abs(e[(x * 5 + y * 3) % 64])
    red = np.where(inside, np.fmax(0.05, np.fmin(1.0, 0.5 + 2 * e[(y // 8) * 8 + x // 8])), 0.01)
    return red, red


def discs(s, d):
    """(vec_id, red, brightest): lit discs of 0..1 on black, some small, some cut by the border, some with a ragged rim."""
    return I.drawn(_dealt(s, d), ["vec_id"], "embedding", ["red", "brightest"], _disc)


QUERIES["view_detection"] = lambda s, d: rounded(W.view_rows(discs(s, d), "vec_id", SIZE), *(m for m in W.MEASURES if m != "mask_px"))


QUERIES["tree_lengths"] = lambda s, d: rounded(V.tree_rows(table(s, d, "embeddings"), "vec_id", 8, "embedding", 0.05).groupBy("vec_id").agg(F.count("*").alias("trees"), F.sum("area").alias("area"), F.sum("length").alias("length")), "length")
ORACLES["tree_lengths"] = f"""WITH RECURSIVE {GRID_SQL}, k AS (SELECT vec_id, y, x FROM g WHERE v > 0.05::DOUBLE), c AS (SELECT vec_id, y, x, y * 8 + x AS r FROM k UNION SELECT k.vec_id, k.y, k.x, c.r FROM c JOIN k ON k.vec_id = c.vec_id AND abs(k.y - c.y) + abs(k.x - c.x) = 1), m AS (SELECT vec_id, y, x, min(r) AS r FROM c GROUP BY 1, 2, 3),
e AS (SELECT k.vec_id, k.y, k.x, min(sqrt((k.y - b.y) * (k.y - b.y) + (k.x - b.x) * (k.x - b.x))) AS dd FROM k JOIN g b ON b.vec_id = k.vec_id AND b.v <= 0.05::DOUBLE GROUP BY 1, 2, 3), z AS (SELECT vec_id, r, count(*) AS area, avg(dd) AS w FROM m JOIN e USING (vec_id, y, x) GROUP BY 1, 2) SELECT vec_id, count(*) AS trees, CAST(sum(area) AS BIGINT) AS area, round(sum(area / (4 * w)), 6) AS length FROM z GROUP BY vec_id"""
_BANDS = {1: "major_vessel_pct", 2: "branch1_vessel_pct", 3: "minor_vessel_pct", 0: "venous_beading_pct"}
QUERIES["calibre_pct"] = lambda s, d: rounded(U.band_percentages(grid(s, d), "vec_id", G.calibre_band(F.abs("v") * 50), _BANDS, F.hypot(F.col("x") - 3.5, F.col("y") - 3.5) <= 4), *_BANDS.values())
_BAND_SQL = "CASE WHEN abs(v) * 50 >= 10.07 THEN 0 WHEN abs(v) * 50 >= 7 THEN 1 WHEN abs(v) * 50 >= 4 THEN 2 WHEN abs(v) * 50 >= 2.685 THEN 3 ELSE -1 END"
ORACLES["calibre_pct"] = f"WITH {GRID_SQL} SELECT vec_id, " + ", ".join(f"round(100.0::DOUBLE * avg(CASE WHEN {_BAND_SQL} = {k} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS {name}" for k, name in _BANDS.items()) + " FROM g WHERE (x - 3.5::DOUBLE) * (x - 3.5::DOUBLE) + (y - 3.5::DOUBLE) * (y - 3.5::DOUBLE) <= 16 GROUP BY vec_id"
QUERIES["largest_component"] = lambda s, d: U.largest_component(N.components(grid(s, d).withColumn("hit", F.col("v") > 0.08), "vec_id", "hit").withColumn("component", (F.shiftright("component", 20) * 8 + F.col("component") % 1048576).cast("long")), "vec_id")
ORACLES["largest_component"] = f"WITH RECURSIVE {GRID_SQL}, k AS (SELECT vec_id, y, x FROM g WHERE v > 0.08::DOUBLE), c AS (SELECT vec_id, y, x, y * 8 + x AS r FROM k UNION SELECT k.vec_id, k.y, k.x, c.r FROM c JOIN k ON k.vec_id = c.vec_id AND abs(k.y - c.y) + abs(k.x - c.x) = 1), m AS (SELECT vec_id, y, x, min(r) AS r FROM c GROUP BY 1, 2, 3), z AS (SELECT vec_id, r, count(*) AS n, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, r) AS nth FROM m GROUP BY 1, 2) SELECT vec_id, CAST(r AS BIGINT) AS component, n AS pixels FROM z WHERE nth = 1"
QUERIES["black_rows"] = lambda s, d: rounded(W.black_rows(table(s, d, "embeddings").select("vec_id", F.expr("transform(embedding, v -> 60 + 600 * v)").alias("brightest")), "vec_id", 8), "in_band_share").withColumn("rows_seen", F.col("rows_seen").cast("long"))
ORACLES["black_rows"] = f"WITH {GRID_SQL}, b AS (SELECT vec_id, y, 100.0::DOUBLE * avg(CASE WHEN 60 + 600 * v <= 10 THEN 1.0::DOUBLE ELSE 0.0 END) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY md5(vec_id || '|' || y || '|0')) AS nth FROM g GROUP BY vec_id, y) SELECT vec_id, CAST(1 AS BIGINT) AS rows_seen, CASE WHEN p BETWEEN 15 AND 25 THEN 1.0::DOUBLE ELSE 0.0 END AS in_band_share, p BETWEEN 15 AND 25 AS passed FROM b WHERE nth = 1"


def _stage2(s, d):
    """Rows of the second stage; candidates are kept by the score that stands in for a classifier, over their sixteen traits within image and lesion."""
    images = eyes(s, d).select("vec_id", "red", "green", "blue")
    # Each image is drawn and looked at once; counts, rows and scores read what was measured.
    measured = T.features_and_candidates(images, "vec_id", SIZE, SMALL)
    path = tables.scratch(s, "features")
    measured.write.parquet(path)
    features, found = T.parted(s.read.schema(measured.schema).parquet(path), "vec_id")
    kept = L.placeholder_score(found, ["vec_id", "lesion"], list(T.FEATURES)).filter(F.col("score") >= L.FALLBACK_THRESHOLD)
    area = float(V.round_view(SIZE, SMALL.measured).sum())
    out = M.stage2_rows(features, kept, "vec_id", area)
    return rounded(out, *(c for c, kind in out.dtypes if kind == "double"))


QUERIES["image_features"] = lambda s, d: rounded(M.image_features(eyes(s, d).select("vec_id", "red", "green", "blue"), "vec_id", SIZE, SMALL), *_SHARES, "od_contrast", "fovea_x", "fovea_y", "fovea_darkness", "od_fovea_dist_dd")
QUERIES["stage2_rows"] = _stage2


#: Photographs' width and height, wide enough for tiles to be equalised, and gates for such small ones.
WIDTH = 128
SMALL_GATES = A.Limits(megapixels=(0.001, 0.01), laplacian=(0.0015, 0.02), tenengrad=(0.02, 30.0), region=(0.001, 0.004))


def _photograph(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, x, p = _places(WIDTH)
    e = e.astype(np.float64)
    inside = (np.abs(x - 63.5) < 53 + 48 * max(0.0, e[1])) & (np.abs(y - 63.5) < 58)
    fall = -90 * np.exp(-((x - 64.0) ** 2) / 900) if abs(e[5]) > 0.25 else 0.0
    light = 110 + 60 * e[(y // 16) * 8 + x // 16] + (x - 64) * 8 * e[2] + fall
    wave = 60 * abs(e[3]) * np.sin((x + 2 * y) * (0.2 + 3 * abs(e[4])))
    grey = np.where(inside, light + wave + p * 7919 % (1 + int(60 * abs(e[6]))), 0.0)
    return _levels(1.25 * grey), _levels(grey), _levels(0.55 * grey)


def photographs(s, d):
    """(vec_id, red, green, blue): textured views on black of levels 0..255; reach, texture, light and exposure lie where values put them."""
    return I.drawn(_dealt(s, d), ["vec_id"], "embedding", ["red", "green", "blue"], _photograph)


_STAGE1 = [c for c in A.STAGE1_COLUMNS if c not in ("stage1_verdict", "enhancement_applied")]
QUERIES["stage1_rows"] = lambda s, d: rounded(A.stage1_rows(photographs(s, d), "vec_id", WIDTH, SMALL_GATES), *_STAGE1)


def placed(s, d):
    """``photographs`` with the middle and radius of their views, which reach past the border so that the spectrum's square is large enough."""
    return photographs(s, d).withColumns({"cy": F.lit(63.5), "cx": F.lit(63.5), "radius": F.lit(72.0)})


QUERIES["focus_rows"] = lambda s, d: rounded(O.focus_rows(placed(s, d), "vec_id", WIDTH), *O.COLUMNS)
