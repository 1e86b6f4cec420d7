"""Deterministic samples: order by a hash of key and seed in place of a random stream."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import numbered as in_order


def hash_order(key: Column, seed: int = 0) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def bands(df: DataFrame, by: list[str], value: str, key: str, n: int = 10) -> DataFrame:
    """``df`` with band: n equal parts of each group by value; floor(i n / rows), so not those of ntile."""
    placed = in_order(df, value, key, by, "_i", "_rows")
    return placed.withColumn("band", F.least(F.floor(F.col("_i") * n / F.col("_rows")), F.lit(n - 1)).cast("int")).drop("_i", "_rows")


def banded_draw(df: DataFrame, by: list[str], value: str, key: str, wanted: int, n: int = 10, seed: int = 0) -> DataFrame:
    """``wanted`` rows of each group, drawn from its bands in turn; adds band and draw_rank."""
    banded = bands(df, by, value, key, n)
    turn = F.row_number().over(Window.partitionBy(*by, "band").orderBy(hash_order(F.col(key), seed), key))
    # A row has all of its band's earlier turns before it, so later turns than ``wanted`` are never drawn; they go before rows meet.
    ranked = banded.withColumn("_turn", turn).filter(F.col("_turn") <= wanted)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_turn", "band"))
    return ranked.withColumn("draw_rank", rank).filter(F.col("draw_rank") <= wanted).drop("_turn")


def split_and_folds(df: DataFrame, by: list[str], key: str, test: int, folds: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with split (test, dev) and cv_fold (text, empty for test): the first rows of each group by hash are test."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(hash_order(F.col(key), seed), key)) - 1
    out = df.withColumn("_i", i)
    is_test = F.col("_i") < test
    fold = F.pmod(F.col("_i") - test, F.lit(folds)).cast("string")
    return out.withColumn("split", F.when(is_test, "test").otherwise("dev")).withColumn("cv_fold", F.when(is_test, "").otherwise(fold)).drop("_i")


def tag_top(df: DataFrame, value: str, key: str, k: int, tag: str, other: str) -> DataFrame:
    """``df`` with source: ``tag`` on the k rows of the highest value.  The k rows are found by a distributed top-k."""
    top = df.orderBy(F.col(value).desc(), key).limit(k).select(key, F.lit(True).alias("_top"))
    return df.join(top, key, "left").withColumn("source", F.when(F.col("_top"), tag).otherwise(other)).drop("_top")


def per_group(df: DataFrame, by: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group by hash."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(hash_order(F.col(key), seed), key))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= k).drop("_nth")


#: The disc's diameter over the image's height, the share of its area that points and squares take.
DIAMETER, POINT_SHARE, SQUARES, SQUARE_SHARE, LEAST_SIDE = 0.75, 0.10, 8, 0.025, 4
POINT_BORDER, POINT_SURPLUS, SQUARE_TRIES = 2, 3, 50


def uniform(*parts: Column | str) -> Column:
    """A number from 0 to below 1 that is a hash of its parts: the same draw wherever and however often it is made."""
    digest = F.substring(F.md5(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))), 1, 12)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 48))


def _radius(height: Column) -> Column:
    return F.lit(DIAMETER) * height / 2


def points_in_disc(images: DataFrame, key: str, height: str, width: str, seed: int = 0) -> DataFrame:
    """(key, nth, y, x): points spread evenly over the disc about the middle, a tenth of its pixels, at least one.

    Three times as many are tried, as roots of uniform radii at uniform angles; those within two pixels of the border go and
    the first that stay are taken, so that an image may have fewer.  Each image's points are made in its own row.
    """
    h, w = F.col(height), F.col(width)
    radius = _radius(h)
    wanted = F.greatest(F.bround(math.pi * radius * radius * POINT_SHARE), F.lit(1)).cast("int")

    def tried(i: Column) -> Column:
        turn, r = 2 * math.pi * uniform(F.col(key), F.lit(seed), F.lit("a"), i), radius * F.sqrt(uniform(F.col(key), F.lit(seed), F.lit("r"), i))
        return F.struct((F.floor(h / 2) + r * F.sin(turn)).cast("int").alias("y"), (F.floor(w / 2) + r * F.cos(turn)).cast("int").alias("x"))

    def fits(p: Column) -> Column:
        return (p["y"] >= POINT_BORDER) & (p["y"] < h - POINT_BORDER) & (p["x"] >= POINT_BORDER) & (p["x"] < w - POINT_BORDER)

    kept = F.slice(F.filter(F.transform(F.sequence(F.lit(0), wanted * POINT_SURPLUS - 1), tried), fits), F.lit(1), wanted)
    return images.select(key, F.posexplode(kept).alias("nth", "_p")).select(key, "nth", "_p.y", "_p.x")


def squares_in_disc(images: DataFrame, key: str, height: str, width: str, seed: int = 0, n: int = SQUARES) -> DataFrame:
    """(key, nth, y0, y1, x0, x1): up to ``n`` squares inside the disc and the image, each a fortieth of the disc, ends exclusive."""
    h, w = F.col(height), F.col(width)
    radius = _radius(h)
    side = F.greatest(F.bround(F.sqrt(math.pi * radius * radius * SQUARE_SHARE)), F.lit(LEAST_SIDE)).cast("int")
    half = F.floor(side / 2).cast("int")

    def tried(i: Column) -> Column:
        turn, r = 2 * math.pi * uniform(F.col(key), F.lit(seed), F.lit("a"), i), (radius - side) * F.sqrt(uniform(F.col(key), F.lit(seed), F.lit("r"), i))
        y, x = (F.floor(h / 2) + r * F.sin(turn)).cast("int") - half, (F.floor(w / 2) + r * F.cos(turn)).cast("int") - half
        return F.struct(y.alias("y0"), (y + side).alias("y1"), x.alias("x0"), (x + side).alias("x1"))

    def fits(s: Column) -> Column:
        return (s["y0"] >= 0) & (s["x0"] >= 0) & (s["y1"] < h) & (s["x1"] < w)

    kept = F.slice(F.filter(F.transform(F.sequence(F.lit(0), F.lit(n * SQUARE_TRIES - 1)), tried), fits), 1, n)
    return images.select(key, F.posexplode(kept).alias("nth", "_s")).select(key, "nth", "_s.*")


def numbered(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """``df`` with number, from 0 inside each label by hash of the key; 256 ranges of the hash run side by side."""
    hashed = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_range", F.substring("_h", 1, 2))
    totals = hashed.groupBy(label, "_range").agg(F.count("*").alias("_t"))
    before = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    bases = totals.select(label, "_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(label, "_range").orderBy("_h", key)
    return hashed.join(bases, [label, "_range"]).withColumn("number", F.col("_base") + F.row_number().over(inside) - 1).drop("_h", "_range", "_base")


def oversampled(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Rows drawn with replacement until every label has as many as the commonest; adds draw, from 0 inside a label.

    Rows without label go.  Draws are dealt over all tasks and meet their rows by number.
    """
    rows = numbered(df.filter(F.col(label).isNotNull()), label, key, seed)
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row for each class
    if not counts:
        return rows.drop("number").withColumn("draw", F.lit(None).cast("long"))
    kind = df.schema[label].dataType
    classes = F.array(*(F.struct(F.lit(c).cast(kind).alias(label), F.lit(n).alias("_n")) for c, n in sorted(counts.items())))
    draws = df.sparkSession.range(max(counts.values())).select(F.col("id").alias("draw"), F.inline(classes))
    pick = F.floor(uniform(F.col(label), F.lit(seed), F.col("draw")) * F.col("_n")).cast("long")
    return draws.withColumn("number", pick).drop("_n").join(rows, [label, "number"]).select(*df.columns, "draw")
