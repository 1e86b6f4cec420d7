"""From lesion candidates to one row an image: scoring, thresholds, counts by quadrant, flags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import rule_421
from .raster import quadrant

#: The working grid (fixed values): radius of the view, disc diameter, reach of the macula, in pixels.
TARGET_R, DD_PX, MACULA_PX = 436, 124, 34
LESIONS = ("ma", "haem", "hard_exudate", "cws")
THRESHOLDS = tuple(round(0.05 * k, 2) for k in range(1, 20))
FALLBACK_THRESHOLD, STRICTEST = 0.5, 0.95

#: Feature blocks in the order in which they are tried (fixed values).
BLOCKS = {
    "6a_measured_core": ["vessel_density_pct", "vessel_fragmentation", "vessel_components", "vessel_largest_tree_pct", "vessel_length", "vessel_orientation_coherence", "nv_score", "nv_score_max", "haem_count", "haem_q_min", "haem_q_max", "rule421_haem"],
    "6b_microaneurysm": ["ma_count", "ma_q1", "ma_q2", "ma_q3", "ma_q4"],
    "6c_calibre_beading": ["major_vessel_pct", "branch1_vessel_pct", "minor_vessel_pct", "venous_beading_pct", "venous_beading_quadrants"],
    "6d_nv_split": ["nvd_score", "nve_score", "nv_irma_quadrants"],
    "6e_exudate_dme": ["hard_exudate_count", "hard_exudate_area_pct", "exudate_fovea_min_dist_dd", "dme_flag"],
    "6f_cws": ["cws_count", "cws_area_pct"],
    "6g_quadrants_421": ["haem_q1", "haem_q2", "haem_q3", "haem_q4", "rule421_beading", "rule421_irma", "severe_npdr_flag"],
}


def inputs_through(block: str) -> list[str]:
    """Columns of all blocks up to one."""
    names = list(BLOCKS)
    if block not in names:
        raise KeyError(f"no feature block {block!r}")
    return [c for n in names[: names.index(block) + 1] for c in BLOCKS[n]]


def schema_gaps(columns: list[str], expected: list[str], carried: list[str] = ()) -> tuple[list[str], list[str]]:
    """(missing, unassigned) columns."""
    return [c for c in expected if c not in columns], [c for c in columns if c not in expected and c not in carried]


def placeholder_score(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """``df`` with score: mean of the features, each scaled to its range inside the image and class (a range of 1e-6 at least)."""
    group = Window.partitionBy(*by)
    scaled = [(F.col(f) - F.min(f).over(group)) / F.greatest(F.max(f).over(group) - F.min(f).over(group), F.lit(1e-6)) for f in features]
    total = scaled[0]
    for s in scaled[1:]:
        total = total + s
    return df.withColumn("score", total / len(features))


def select_threshold(scored: DataFrame, images: DataFrame, key: str, score: str) -> DataFrame:
    """(threshold): the lowest of the grid at which the median number of kept candidates over ``images`` is 0.

    images are the negative training images; those without candidates count as 0.  Without images, or if none
    of the grid does, the fallback or the strictest value.
    """
    kept = [F.sum((F.col(score) >= t).cast("int")).alias(f"_{i}") for i, t in enumerate(THRESHOLDS)]
    every = images.select(key).distinct().join(scored.groupBy(key).agg(*kept), key, "left")
    # The median of counts, which are never negative, is 0 exactly if more than half of them are.
    zeros = every.agg(F.count("*").alias("n"), *(F.sum((F.coalesce(f"_{i}", F.lit(0)) == 0).cast("long")).alias(f"_{i}") for i in range(len(THRESHOLDS))))
    enough = lambda i: F.col(f"_{i}") * 2 > F.col("n")
    lowest = F.coalesce(*(F.when(enough(i), F.lit(t)) for i, t in enumerate(THRESHOLDS)))
    return zeros.select(F.when(F.col("n") == 0, FALLBACK_THRESHOLD).otherwise(F.coalesce(lowest, F.lit(STRICTEST))).alias("threshold"))


def macula_touch(x: Column, y: Column, area: Column, fovea_x: Column, fovea_y: Column) -> Column:
    """The candidate's equal-area disc reaches the macula."""
    return F.hypot(x - fovea_x, y - fovea_y) - F.sqrt(area / math.pi) <= MACULA_PX


def image_rows(images: DataFrame, kept: DataFrame, key: str, mask_area: float) -> DataFrame:
    """One row an image from its kept candidates.

    images: key, od_x, od_y, fovea_x, fovea_y, venous_beading_quadrants, nv_irma_quadrants.
    kept: key, lesion, cx, cy, area.  Counts are 0 and the distance to the macula is the longest possible one where nothing is kept.
    """
    axis = F.atan2(F.col("fovea_y") - F.col("od_y"), F.col("fovea_x") - F.col("od_x"))
    placed = kept.join(images.select(key, "od_x", "od_y", "fovea_x", "fovea_y"), key).withColumn("q", quadrant(F.col("cx"), F.col("cy"), axis, F.col("od_x"), F.col("od_y")))
    of = lambda lesion, extra=None: (F.col("lesion") == lesion) & (extra if extra is not None else F.lit(True))
    count = lambda c: F.sum(c.cast("int"))
    away = F.hypot(F.col("cx") - F.col("fovea_x"), F.col("cy") - F.col("fovea_y")) / DD_PX
    touch = macula_touch(F.col("cx"), F.col("cy"), F.col("area"), F.col("fovea_x"), F.col("fovea_y"))
    sums = placed.groupBy(key).agg(
        *(count(of(lesion)).alias(f"{lesion}_count") for lesion in LESIONS),
        *(count(of(lesion, F.col("q") == k)).alias(f"{lesion}_q{k + 1}") for lesion in ("haem", "ma") for k in range(4)),
        *((100.0 * F.sum(F.when(of(lesion), F.col("area")).otherwise(0.0)) / max(mask_area, 1.0)).alias(f"{lesion}_area_pct") for lesion in ("hard_exudate", "cws")),
        F.min(F.when(of("hard_exudate"), away)).alias("exudate_fovea_min_dist_dd"),
        F.max((of("hard_exudate", touch)).cast("int")).alias("dme_flag"),
    )
    farthest = 2 * TARGET_R * math.sqrt(2.0) / DD_PX
    rows = images.join(sums, key, "left").fillna({"exudate_fovea_min_dist_dd": farthest}).fillna(0, [c for c in sums.columns if c != key])
    quarters = F.array(*(F.col(f"haem_q{k}") for k in range(1, 5)))
    signs = rule_421(quarters, F.col("venous_beading_quadrants"), F.col("nv_irma_quadrants"))
    return rows.withColumns(
        {
            "haem_q_min": F.array_min(quarters),
            "haem_q_max": F.array_max(quarters),
            "rule421_haem": signs["haemorrhages"].cast("int"),
            "rule421_beading": signs["beading"].cast("int"),
            "rule421_irma": signs["irma"].cast("int"),
            "severe_npdr_flag": signs["severe"].cast("int"),
        }
    )
