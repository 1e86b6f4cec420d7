"""Small reports over groups: masked statistics, histograms, balances, shares, and the usable rows that they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import percentiles


def masked_summary(df: DataFrame, by: list[str], value: str, mask: Column, shares: dict[str, float]) -> DataFrame:
    """(by..., mean, spread, variance, top, fraction, one column a share): statistics of the values under the mask, over the population.

    fraction is the share of rows under the mask.  Percentiles are exact and linear; a group whose mask is empty has nulls and the fraction 0.
    """
    rows = df.withColumn("_m", F.when(mask, F.col(value).cast("double")))
    plain = rows.groupBy(*by).agg(
        F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("spread"), F.var_pop("_m").alias("variance"), F.max("_m").alias("top"),
        F.avg(F.coalesce(mask, F.lit(False)).cast("double")).alias("fraction"),
    )
    found = percentiles(rows, ["_m"], sorted(set(shares.values())), by)
    wide = found.groupBy(*by).agg(*(F.max(F.when(F.col("share") == F.lit(float(x)), F.col("value"))).alias(name) for name, x in shares.items()))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    return plain.alias("a").join(wide.alias("b"), same, "left").select(*(F.col(f"a.{c}") for c in plain.columns), *(F.col(f"b.{c}") for c in shares))


def histogram(df: DataFrame, bin_of: Column, bins: int, weight: Column | None = None) -> DataFrame:
    """(bin, n) of bins 0 to ``bins`` - 1, empty ones included; n is the sum of the weights where there are any.  Other bins are left out."""
    total = F.count("*") if weight is None else F.sum(weight)
    counted = df.groupBy(bin_of.cast("long").alias("bin")).agg(total.alias("n"))
    none = F.lit(0) if weight is None else F.lit(0.0)
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counted, "bin", "left").withColumn("n", F.coalesce("n", none))


def rejections(df: DataFrame, rejected: Column, grade: str, unknown: str = "?") -> DataFrame:
    """(grade, n): rejected rows by grade; rows of no grade count under ``unknown``."""
    return df.filter(rejected).groupBy(F.coalesce(F.col(grade).cast("string"), F.lit(unknown)).alias("grade")).agg(F.count("*").alias("n"))


def balance(df: DataFrame, by: str, kind: str, kinds: list[str], share_of: str) -> DataFrame:
    """(by, n_<kind>..., total, share_<kind>): rows of each kind in a group, and the per cent that one kind has."""
    counts = [F.sum((F.col(kind) == x).cast("long")).alias(f"n_{x.lower()}") for x in kinds]
    rows = df.groupBy(by).agg(*counts, F.count("*").alias("total"))
    return rows.withColumn(f"share_{share_of.lower()}", 100.0 * F.col(f"n_{share_of.lower()}") / F.col("total"))


def usable(df: DataFrame, grade: Column, grades: list, metric: str, view_ok: Column) -> DataFrame:
    """Rows of a known grade whose metric is there and whose view was not marked as bad; a missing mark counts as good."""
    return df.filter(grade.isin(*grades) & F.col(metric).isNotNull() & F.coalesce(view_ok, F.lit(True)))


def cumulative_shares(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share): share of the rows up to and with each label; the order runs over a row a label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.sum("n").over(Window.orderBy(label)) / F.sum("n").over(Window.partitionBy()))


def band_percentages(df: DataFrame, by: str, band: Column, names: dict[int, str], measured: Column | None = None) -> DataFrame:
    """(by, names...): per cent of the measured rows that are of each band; all rows are measured if no condition is given."""
    inside = F.lit(True) if measured is None else measured
    within = F.greatest(F.sum(inside.cast("long")), F.lit(1))
    return df.groupBy(by).agg(*((100.0 * F.sum((inside & (band == k)).cast("long")) / within).alias(name) for k, name in names.items()))


def largest_component(pixels: DataFrame, key: str, component: str = "component") -> DataFrame:
    """(key, component, pixels) of each image's largest component; of equal ones the one with the smallest number."""
    sizes = pixels.groupBy(key, component).agg(F.count("*").alias("pixels"))
    best = F.max_by(F.struct(component, "pixels"), F.struct("pixels", -F.col(component)))
    return sizes.groupBy(key).agg(best.alias("_b")).select(key, f"_b.{component}", "_b.pixels")
