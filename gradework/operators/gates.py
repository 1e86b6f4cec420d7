"""Decisions on one row: thresholds, cascades, bands, flags and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.coerce import clip

PASS, BORDERLINE, FAIL = "pass", "borderline", "fail"
#: Megapixels below which an image fails or is borderline (fixed values).
MEGAPIXELS = (0.3, 1.0)
#: Aspect ratio -> per cent of black pixels that a row of such an image has (fixed values).
ASPECT_BANDS = {1.00: (15.0, 25.0), 1.33: (15.0, 45.0), 1.39: (15.0, 47.5), 1.51: (15.0, 50.0)}
FLAT_FIELD, CLAHE = 1, 2


def trichotomy(value: Column, fail_below: Column | float, borderline_below: Column | float) -> Column:
    return F.when(value < fail_below, F.lit(FAIL)).when(value < borderline_below, F.lit(BORDERLINE)).otherwise(F.lit(PASS))


def pixel_gate(width: Column, height: Column) -> Column:
    return trichotomy(width.cast("double") * height / 1e6, *MEGAPIXELS)


def area_ratio_gate(horizontal: Column, vertical: Column, low: float = 0.85, high: float = 1.15) -> Column:
    """Both squared radii lie strictly inside the band of the squared mean radius; a zero radius fails."""
    mean = (horizontal + vertical) / 2.0
    share = lambda r: F.try_divide(r * r, F.nullif(mean * mean, F.lit(0.0)))
    inside = lambda s: (s > low) & (s < high)
    fine = inside(share(horizontal)) & inside(share(vertical)) & (horizontal > 0) & (vertical > 0)
    return F.when(F.coalesce(fine, F.lit(False)), F.lit(PASS)).otherwise(F.lit(FAIL))


def area_fraction_gate(pixels: Column, horizontal: Column, vertical: Column, least: float = 0.5) -> Column:
    """Mask pixels over the area of the larger radius's circle."""
    radius = F.greatest(horizontal, vertical)
    share = F.try_divide(pixels, F.nullif(radius * radius * 3.141592653589793, F.lit(0.0)))
    return F.when(F.coalesce(share >= least, F.lit(False)), F.lit(PASS)).otherwise(F.lit(FAIL))


def nearest_band(aspect: Column, bands: dict[float, tuple[float, float]] | None = None) -> Column:
    """struct(key, lo, hi) of the nearest key; the first among equals."""
    rows = [F.struct(F.abs(aspect - k).alias("gap"), F.lit(i).alias("at"), F.lit(k).alias("key"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (k, (lo, hi)) in enumerate((bands or ASPECT_BANDS).items())]
    best = F.array_min(F.array(*rows))
    return F.struct(best["key"].alias("key"), best["lo"].alias("lo"), best["hi"].alias("hi"))


def first_failure(*stages: tuple[str, Column]) -> Column:
    """Name of the first stage that failed, or null."""
    return F.coalesce(*(F.when(status == FAIL, F.lit(name)) for name, status in stages))


def cascade(*stages: tuple[str, Column]) -> Column:
    """struct(status, stage, borderline_sources): a failure ends it; a borderline does not."""
    failed = first_failure(*stages)
    sources = F.array_compact(F.array(*(F.when(status == BORDERLINE, F.lit(name)) for name, status in stages)))
    status = F.when(failed.isNotNull(), F.lit(FAIL)).when(F.size(sources) > 0, F.lit(BORDERLINE)).otherwise(F.lit(PASS))
    return F.struct(status.alias("status"), failed.alias("stage"), F.when(failed.isNull(), sources).alias("borderline_sources"))


def enhancement_bits(verdict: Column, flat_field: Column, clahe: Column) -> Column:
    """Bit field of what was applied; only borderline images are enhanced."""
    bits = F.when(flat_field, FLAT_FIELD).otherwise(0).bitwiseOR(F.when(clahe, CLAHE).otherwise(0))
    return F.when(verdict == BORDERLINE, bits).otherwise(0)


def cut_grade(score: Column, cuts: Column) -> Column:
    """Number of cut points strictly below the score."""
    return F.size(F.filter(cuts, lambda c: c < score))


def routed_confidence(probability: Column, borderline: Column, enhanced: Column) -> Column:
    """A borderline image keeps 0.85 of its confidence, an enhanced one 0.90 (fixed values)."""
    return clip(probability * F.when(borderline, 0.85).otherwise(1.0) * F.when(enhanced, 0.90).otherwise(1.0), 0.0, 1.0)


def macular_override(referable: Column, macular: Column) -> Column:
    """struct(referable, urgent): lesions near the macula are always referred, at once."""
    return F.struct((referable | macular).alias("referable"), macular.alias("urgent"))


def rule_421(haemorrhages: Column, beading_quadrants: Column, irma_quadrants: Column) -> Column:
    """struct of the three signs and their union: more than 3 haemorrhages in all four quadrants, beading in two, IRMA in one."""
    a, b, c = F.forall(haemorrhages, lambda n: n > 3), beading_quadrants >= 2, irma_quadrants >= 1
    return F.struct(a.alias("haemorrhages"), b.alias("beading"), c.alias("irma"), (a | b | c).alias("severe"))


def criterion(rule421: Column, new_vessels: Column, haemorrhages: Column, aneurysms: Column) -> Column:
    """Which finding a report names first."""
    # The texts of a report.
    quadrants = "4-2-1: haemorrhages in all four quadrants"
    vessels = "Neovascularisation signal elevated"
    lesions = "Microaneurysms / haemorrhages present"
    none = "No lesion criterion met; grade from vessel and NV features"
    return F.when(rule421, quadrants).when(new_vessels > 3.0, vessels).when((haemorrhages > 0) | (aneurysms > 0), lesions).otherwise(none)


def calibre_band(width: Column) -> Column:
    """Vessel calibre class of a width in pixels, widest first (fixed values)."""
    return F.when(width >= 10.07, 0).when(width >= 7.0, 1).when(width >= 4.0, 2).when(width >= 2.685, 3).otherwise(-1)


def fast_reject(residual: Column, area_share: Column, offset: Column, border_share: Column) -> Column:
    """struct(rejected, reason): a view that fits its circle badly, is small, far off or mostly at the border (fixed values)."""
    reasons = F.concat_ws("|", F.when(residual > 0.06, "residual"), F.when(area_share < 0.50, "areaFrac"), F.when(offset > 0.35, "offset"), F.when(border_share > 0.80, "borderFrac"))
    return F.struct((F.length(reasons) > 0).alias("rejected"), reasons.alias("reason"))


def saturated_green(share: Column, most: float = 0.05) -> Column:
    """More than a twentieth of the green channel is saturated; an unknown share is not."""
    return F.coalesce(share > most, F.lit(False))


def sharp_enough(normed_variance: Column, least: float = 0.082) -> Column:
    """The variance of the Laplacian over the squared mean is high enough for vessels to be measured."""
    return F.coalesce(normed_variance >= least, F.lit(False))
