"""Fold-wise lesion scores: no candidate is scored by a model that saw its image.

Models are fitted for each fold on the other folds' images, and for the test images on all that are not test.  Image rows are then
recomputed from the candidates that are kept, and overlay the columns that depend on a classifier; all other columns stay as
they were measured.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from . import grading as M
from . import lesion as L

TEST = "test"
#: Weak labels by the image's grade (fixed values): candidates of other grades are scored, but teach nothing.
NEGATIVE, POSITIVE = (0,), (3, 4)
#: Columns of an image that depend on a lesion classifier (fixed values).
DEPENDENT = (
    "haem_count", "haem_q1", "haem_q2", "haem_q3", "haem_q4", "haem_q_min", "haem_q_max",
    "hard_exudate_count", "hard_exudate_area_pct", "exudate_fovea_min_dist_dd", "dme_flag",
    "cws_count", "cws_area_pct", "rule421_haem", "severe_npdr_flag",
    "ma_count", "ma_q1", "ma_q2", "ma_q3", "ma_q4",
)


def dev(df: DataFrame) -> DataFrame:
    return df.filter("split = 'dev'")


def test(df: DataFrame) -> DataFrame:
    return df.filter("split = 'test'")


def in_fold(df: DataFrame, k: str) -> DataFrame:
    """Rows of fold ``k``, whatever their split."""
    return df.filter(F.col("cv_fold").cast("string") == k)


def not_in_fold(df: DataFrame, k: str) -> DataFrame:
    """Rows that a model for fold ``k`` may see."""
    return dev(df).filter(F.coalesce(F.col("cv_fold").cast("string"), F.lit("")) != k)


def folds(df: DataFrame) -> list[str]:
    """The folds of the rows that are not test, in order; a handful."""
    return sorted(r[0] for r in dev(df).select(F.col("cv_fold").cast("string")).distinct().collect() if r[0] and r[0].strip())


def matrix(df: DataFrame, features: list[str], overrides: DataFrame | None = None, key: str = "id_code", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry..., features) as numbers, in the order asked for; columns of ``overrides`` (key, columns...) come before the table's own."""
    from ..functions.coerce import to_number

    rows = df
    if overrides is not None:
        rows = overlaid(df, overrides, key)
    return rows.select(key, *carry, *(to_number(F.col(c).cast("string")).alias(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in features))


def overlaid(df: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``overrides`` in place of its own, where it has a row for the key; rows without one stay."""
    columns = [c for c in overrides.columns if c != key]
    given = overrides.select(key, F.struct(*columns).alias("_over"))
    out = df.join(given, key, "left")
    for c in columns:
        own = F.col(c) if c in df.columns else F.lit(None)
        out = out.withColumn(c, F.when(F.col("_over").isNotNull(), F.col(f"_over.{c}")).otherwise(own))
    return out.drop("_over")


def confidence_flags(df: DataFrame) -> tuple[Column, Column]:
    """(borderline, enhanced) of a row, for the routing of confidence."""
    verdict = F.lower(F.trim(F.coalesce(F.col("stage1_verdict").cast("string"), F.lit(""))))
    level = F.coalesce(F.expr("try_cast(enhancement_applied as double)"), F.lit(0.0))
    return verdict == "borderline", (level > 0) & ~F.isnan(level)  # NaN sorts above all numbers, but is no enhancement


def weak_label(grade: Column) -> Column:
    return F.when(grade.isin(*NEGATIVE), 0.0).when(grade.isin(*POSITIVE), 1.0)


@dataclass
class Classifier:
    """A lesion's classifier for one fold; without a model the placeholder score is taken."""

    model: object | None
    threshold: float


def fit_fold(candidates: DataFrame, images: DataFrame, features: list[str], fold: str, lesions: tuple[str, ...] = L.LESIONS, key: str = "id_code", trees: int = 200) -> dict[str, Classifier]:
    """lesion -> classifier of one fold, or of the test images.

    candidates: key, lesion, features.  images: key, grade, split, cv_fold.  Weights and threshold come from the training images alone.
    """
    seen = (dev(images) if fold == TEST else not_in_fold(images, fold)).select(key, "grade")
    labelled = candidates.join(seen, key).withColumn("_label", weak_label(F.col("grade"))).filter("_label is not null").select(key, *features, "grade", "_label", "lesion")
    # Trees take many passes: candidates meet their grades once a fold, not once a pass.
    labelled = labelled.persist(StorageLevel.DISK_ONLY)
    out = {}
    for lesion in lesions:
        own = labelled.filter(F.col("lesion") == lesion)
        model = M.forest(own, features, "_label", trees=trees)
        threshold = L.FALLBACK_THRESHOLD
        if model is not None:
            negative = seen.filter(F.col("grade").isin(*NEGATIVE))
            scored = M.forest_score(model, own.filter(F.col("grade").isin(*NEGATIVE)).select(key, *features), features)
            threshold = float(L.select_threshold(scored, negative, key, "score").first()["threshold"])
        out[lesion] = Classifier(model, threshold)
    labelled.unpersist()
    return out


def scored_out_of_fold(candidates: DataFrame, images: DataFrame, features: list[str], fitted: dict[str, dict[str, Classifier]], key: str = "id_code") -> DataFrame:
    """``candidates`` with fold, score and kept; ``fitted`` is fold -> lesion -> classifier, ``TEST`` among the folds for the test images.

    Each candidate meets the one model of its image's fold and its lesion.  Candidates are written once by fold and lesion, so that each
    model reads its own files only and all are read once.  Images without a fold, and candidates without an image, are left out.
    """
    spark = candidates.sparkSession
    place = F.when(F.col("split") == TEST, F.lit(TEST)).otherwise(F.col("cv_fold").cast("string"))
    path = tables.scratch(spark, "candidates")
    dealt = candidates.join(images.select(key, place.alias("fold")), key).filter(F.col("fold").isin(*fitted))
    dealt.write.partitionBy("fold", "lesion").parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path).select(*dealt.columns)
    out: DataFrame | None = None
    for fold, own in sorted(fitted.items()):
        for lesion, classifier in sorted(own.items()):
            part = rows.filter((F.col("fold") == fold) & (F.col("lesion") == lesion))
            if classifier.model is None:
                part = L.placeholder_score(part, [key], features)
            else:
                part = M.forest_score(classifier.model, part, features)
            part = part.withColumn("kept", F.col("score") >= F.lit(classifier.threshold))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold has a classifier")
    return out


def recomputed(dataset: DataFrame, scored: DataFrame, mask_area: float, key: str = "id_code") -> DataFrame:
    """``dataset`` with its classifier-dependent columns recomputed from the kept candidates.

    dataset: key, od_x, od_y, fovea_x, fovea_y, venous_beading_quadrants, nv_irma_quadrants and the columns to be replaced.  An image whose
    candidates were all turned down has counts of 0; one that has no candidates at all keeps its row as it is.
    """
    marks = [key, "od_x", "od_y", "fovea_x", "fovea_y", "venous_beading_quadrants", "nv_irma_quadrants"]
    known = dataset.select(*marks).join(scored.select(key).distinct(), key, "left_semi")
    rows = L.image_rows(known, scored.filter("kept").select(key, "lesion", "cx", "cy", "area"), key, mask_area)
    return overlaid(dataset, rows.select(key, *DEPENDENT), key)
