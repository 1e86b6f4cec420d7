"""Order-based aggregates that no single task has to hold: values are dealt into ranges first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def dealt(df: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with _range, growing with ``value``; cut points are approximate quantiles, equal values stay together."""
    cuts = sorted(set(df.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.01)))
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    return df.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))))


def running_sums(df: DataFrame, value: str, sums: dict[str, str], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """``df`` with running sums {new column: column} over rows by ``value``, each row's own included.

    With ``by`` each group runs alone, in one task.  Without, ranges run side by side and get the totals of
    those before them; ``value`` must be distinct.
    """
    order = F.col(value).desc() if descending else F.col(value)
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({new: F.sum(old).over(w) for new, old in sums.items()})
    df = dealt(df, value)
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.col("_range").desc() if descending else F.col("_range")
    before = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_range").agg(*(F.sum(old).alias(f"_t_{new}") for new, old in sums.items()))  # RANGES rows
    bases = totals.select("_range", *(F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_b_{new}") for new in sums))
    out = df.join(F.broadcast(bases), "_range").withColumns({new: F.col(f"_b_{new}") + F.sum(old).over(inside) for new, old in sums.items()})
    return out.drop("_range", *(f"_b_{new}" for new in sums))


def _based(counted: DataFrame, n: Column, by: list[str]) -> DataFrame:
    """``counted``, which has _range, with _base, the sum of ``n`` in the ranges of its group that lie before its own, and _all, that of the group."""
    keys = [*by, "_range"]
    totals = counted.groupBy(*keys).agg(F.sum(n).alias("_t"))  # a row for each range of a group
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_base"), F.sum("_t").over(Window.partitionBy(*by)).alias("_all"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return counted.alias("a").join(bases.alias("b"), same).select(*(F.col(f"a.{c}") for c in counted.columns), "_base", "_all")


def ranks(df: DataFrame, value: str, by: list[str], rank: str) -> DataFrame:
    """(by..., value, rank) of the distinct values of each group, nulls first; ties share the mean of their ranks.

    Equal values are counted first and ranges of values run side by side, so that no task has a group or all copies of a value.
    """
    counted = dealt(df.groupBy(*by, value).agg(F.count("*").alias("_n")), value)
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_base") + F.sum("_n").over(inside)
    return _based(counted, F.col("_n"), by).select(*by, value, (end - (F.col("_n") - 1) / 2).alias(rank))


def numbered(df: DataFrame, value: str, key: str, by: list[str], number: str, total: str) -> DataFrame:
    """``df`` with number, from 0 inside each group by value, then key, and total, the group's rows; ranges of values run side by side."""
    rows = dealt(df, value)
    inside = Window.partitionBy(*by, "_range").orderBy(value, key)
    out = _based(rows, F.lit(1), by).withColumn(number, F.col("_base") + F.row_number().over(inside) - 1)
    return out.withColumnRenamed("_all", total).drop("_range", "_base")


def percentiles(df: DataFrame, columns: list[str], shares: list[float], by: list[str] | None = None, ranges: int = RANGES, pooled: str | None = None) -> DataFrame:
    """(by..., metric, n, share, value): exact percentiles, linear between neighbours, of many columns inside groups; nulls do not count.

    Equal values are counted first.  Ranges of values run side by side and know how many values lie in the ranges
    before them, so neither a column nor a group is ever in one task or one buffer.  Only ranges on which an asked
    place falls are put in order.  A group without values has no row.  With ``pooled``, all rows are a group of that
    name as well, added up from the counts of the groups; rows whose (one, textual) ``by`` is null are in it alone.
    """
    by = by or []
    rows = df.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("_v")) for c in columns)))).filter("_v is not null")
    counted = rows.groupBy(*by, "metric", "_v").agg(F.count("*").alias("_n"))
    if pooled is not None:
        (group,) = by
        whole = counted.groupBy(F.lit(pooled).alias(group), "metric", "_v").agg(F.sum("_n").alias("_n"))
        counted = counted.filter(F.col(group).isNotNull()).unionByName(whole)
    numbers = df.select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)))
    found = numbers.approxQuantile([f"_{i}" for i in range(len(columns))], [k / ranges for k in range(1, ranges)], 0.01)
    place = F.lit(0)
    for name, cuts in zip(columns, found):
        edges = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
        place = F.when(F.col("metric") == name, F.size(F.filter(edges, lambda c: c < F.col("_v")))).otherwise(place)
    keys = [*by, "metric"]
    dealt_out = counted.withColumn("_range", place)
    totals = dealt_out.groupBy(*keys, "_range").agg(F.sum("_n").alias("_t"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = totals.select(*keys, "_range", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_base"), F.sum("_t").over(Window.partitionBy(*keys)).alias("n"), "_t")
    at = lambda share: (F.col("n") - 1) * share
    every = F.array(*(F.lit(float(x)) for x in shares))
    inside_of = lambda place: (F.col("_base") <= place) & (place < F.col("_base") + F.col("_t"))
    bases = bases.filter(F.exists(every, lambda x: inside_of(F.floor(at(x))) | inside_of(F.ceil(at(x)))))  # at most two a share and group
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "_range")]
    met = dealt_out.alias("a").join(bases.hint("shuffle_hash").alias("b"), same).select(*(F.col(f"a.{k}") for k in (*keys, "_range")), "_v", "_n", "_base", "n")
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ends = met.withColumn("_end", F.col("_base") + F.sum("_n").over(inside)).withColumn("_begin", F.col("_end") - F.col("_n"))
    # Each value answers the shares whose place, from 0, or the next place falls on it.
    holds = lambda at: (F.col("_begin") <= at) & (at < F.col("_end"))
    asked = F.filter(every, lambda x: holds(F.floor(at(x))) | holds(F.ceil(at(x))))
    hits = ends.withColumn("_asked", asked).filter(F.size("_asked") > 0).select(*keys, "n", "_v", "_begin", "_end", F.explode("_asked").alias("share"))
    pair = hits.groupBy(*keys, "n", "share").agg(F.max(F.when(holds(F.floor(at(F.col("share")))), F.col("_v"))).alias("_low"), F.max(F.when(holds(F.ceil(at(F.col("share")))), F.col("_v"))).alias("_high"))
    part = at(F.col("share")) - F.floor(at(F.col("share")))
    return pair.select(*keys, "n", "share", (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias("value"))


def neighbours(df: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """(value, next) of the distinct values of a column; the largest has no next.

    Ranges run side by side; the last value of a range takes the first one of the next range that has values.
    """
    distinct = dealt(df.select(value).filter(F.col(value).isNotNull()).distinct(), value, ranges)
    firsts = distinct.groupBy("_range").agg(F.min(value).alias("_first"))  # a row for each range
    after = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_after"))
    inside = Window.partitionBy("_range").orderBy(value)
    return distinct.join(F.broadcast(after), "_range").select(value, F.coalesce(F.lead(value).over(inside), "_after").alias("next"))
