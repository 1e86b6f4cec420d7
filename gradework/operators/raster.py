"""Raster operators on pixel relations (key, y, x, v): windows along rows and columns, offset joins, moments.

Every window is partitioned by image and line, so a task holds one line; nothing crosses images.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .images import per_image


def pixels(df: DataFrame, key: str, values: str, width: int, *carry: str) -> DataFrame:
    """(key, carry..., y, x, v) of row-major arrays."""
    rows = df.select(key, *carry, F.posexplode(values).alias("_p", "_v"))
    return rows.select(key, *carry, F.floor(F.col("_p") / width).cast("int").alias("y"), (F.col("_p") % width).cast("int").alias("x"), F.col("_v").cast("double").alias("v"))


def along(key: str, axis: str):
    """Window over a line: axis x runs along a row, y along a column."""
    return Window.partitionBy(key, "y" if axis == "x" else "x").orderBy(axis)


def laplacian(px: DataFrame, key: str) -> DataFrame:
    """``px`` with lap, the five-point Laplacian; null on the border."""
    row, column = along(key, "x"), along(key, "y")
    around = F.lag("v").over(row) + F.lead("v").over(row) + F.lag("v").over(column) + F.lead("v").over(column)
    return px.withColumn("lap", around - 4 * F.col("v"))


def normed_laplacian(px: DataFrame, key: str) -> DataFrame:
    """(key, lap_norm): variance of the Laplacian over the squared mean intensity."""
    return laplacian(px, key).groupBy(key).agg((F.var_pop("lap") / F.pow(F.avg("v") + 1e-6, 2)).alias("lap_norm"))


def brenner(px: DataFrame, key: str, shift: int = 2) -> DataFrame:
    """(key, brenner): mean of the mean squared differences of pixels ``shift`` apart, along rows and columns."""
    step = lambda axis: F.lead("v", shift).over(along(key, axis)) - F.col("v")
    rows = px.withColumn("_h", step("x")).withColumn("_w", step("y"))
    return rows.groupBy(key).agg(((F.avg(F.col("_h") * F.col("_h")) + F.avg(F.col("_w") * F.col("_w"))) / 2).alias("brenner"))


def padded(px: DataFrame, key: str, height: int, width: int, by: int, mode: str = "reflect") -> DataFrame:
    """``px`` with ``by`` more pixels on each side: reflect repeats the border pixel, mirror does not, replicate holds it."""

    def at(axis: str, size: int) -> Column:
        places = F.sequence(F.lit(-by), F.lit(size + by - 1))
        inside = {
            "reflect": lambda i: F.when(i < 0, -1 - i).when(i >= size, 2 * size - 1 - i).otherwise(i),
            "mirror": lambda i: F.when(i < 0, -i).when(i >= size, 2 * size - 2 - i).otherwise(i),
            "replicate": lambda i: F.least(F.greatest(i, F.lit(0)), F.lit(size - 1)),
        }[mode]
        return F.filter(places, lambda i: inside(i) == F.col(axis))

    rows = px.withColumn("_y", F.explode(at("y", height))).withColumn("_x", F.explode(at("x", width)))
    return rows.drop("y", "x").withColumnsRenamed({"_y": "y", "_x": "x"})


def tenengrad(px: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """(key, tenengrad): variance of the squared Sobel gradient over the squared mean; edges reflect."""
    ext = padded(px, key, height, width, 1)
    row, column = along(key, "x"), along(key, "y")
    ext = ext.withColumn("_dx", F.lead("v").over(row) - F.lag("v").over(row)).withColumn("_sx", F.lead("v").over(row) + 2 * F.col("v") + F.lag("v").over(row))
    gx = F.lag("_dx").over(column) + 2 * F.col("_dx") + F.lead("_dx").over(column)
    gy = F.lead("_sx").over(column) - F.lag("_sx").over(column)
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    rows = ext.withColumn("_g", gx * gx + gy * gy).filter(inside)
    return rows.groupBy(key).agg((F.var_pop("_g") / F.pow(F.avg("v") + 1e-6, 2)).alias("tenengrad"))


def box(px: DataFrame, key: str, height: int, width: int, size: int, how, mode: str = "reflect") -> DataFrame:
    """(key, y, x, v): a separable moving aggregate (avg, min, max) of ``size`` x ``size``."""
    half = size // 2
    ext = padded(px.select(key, "y", "x", "v"), key, height, width, half, mode)
    for axis in ("x", "y"):
        ext = ext.withColumn("v", how("v").over(along(key, axis).rowsBetween(-half, half)))
    return ext.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def local_contrast(px: DataFrame, key: str, height: int, width: int, size: int) -> DataFrame:
    """(key, contrast): mean over pixels of the local standard deviation, its variance not below 0."""
    mean = box(px, key, height, width, size, F.avg).withColumnRenamed("v", "m")
    square = box(px.withColumn("v", F.col("v") * F.col("v")), key, height, width, size, F.avg).withColumnRenamed("v", "s")
    spread = F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0)))
    return mean.join(square, [key, "y", "x"]).groupBy(key).agg(F.avg(spread).alias("contrast"))


def median(px: DataFrame, key: str, size: int) -> DataFrame:
    """(key, y, x, v): median of the pixels of a window that lie in the image; each pixel is sent to its neighbours."""
    half = size // 2
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-half, half + 1) for dx in range(-half, half + 1)))
    sent = px.select(key, "y", "x", "v", F.inline(offsets)).select(key, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")
    return sent.join(px.select(key, "y", "x"), [key, "y", "x"], "left_semi").groupBy(key, "y", "x").agg(F.percentile("v", F.lit(0.5)).alias("v"))


def convolve(px: DataFrame, key: str, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """(key, y, x, v): sum of kernel[dy, dx] times the pixel at (y + dy, x + dx); outside is 0."""
    taps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for (dy, dx), w in sorted(kernel.items())))
    sent = px.select(key, "y", "x", "v", F.inline(taps)).select(key, (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"), (F.col("v") * F.col("w")).alias("v"))
    return sent.join(px.select(key, "y", "x"), [key, "y", "x"], "left_semi").groupBy(key, "y", "x").agg(F.sum("v").alias("v"))


def line_kernel(length: int, angle: float) -> dict[tuple[int, int], float]:
    """Mean along a line through the middle."""
    half = length // 2
    places = {(round(t * math.sin(angle)), round(t * math.cos(angle))) for t in range(-half, half + 1)}
    return {p: 1.0 / len(places) for p in places}


def matched_kernel(angle: float, sigma: float = 2.0, length: int = 9) -> dict[tuple[int, int], float]:
    """A dark line's profile along ``angle``, of mean 0 on its support."""
    half = math.ceil(max(3 * sigma, length / 2))
    raw = {}
    for y in range(-half, half + 1):
        for x in range(-half, half + 1):
            across, down = x * math.sin(angle) - y * math.cos(angle), x * math.cos(angle) + y * math.sin(angle)
            if abs(across) <= 3 * sigma and abs(down) <= length / 2:
                raw[y, x] = -math.exp(-(across**2) / (2 * sigma**2))
    mean = sum(raw.values()) / len(raw)
    return {k: v - mean for k, v in raw.items()}


def strongest(px: DataFrame, key: str, kernels: list[dict[tuple[int, int], float]]) -> DataFrame:
    """(key, y, x, v, at): the largest response over kernels and which one gave it, the first among equals."""
    rows = None
    for i, kernel in enumerate(kernels):
        one = convolve(px, key, kernel).withColumn("at", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key, "y", "x").agg(F.max("v").alias("v"), F.max_by("at", F.struct("v", -F.col("at"))).alias("at"))


def strongest_rows(images: DataFrame, key: str, width: int, values: str, kernels: list[dict[tuple[int, int], float]]) -> DataFrame:
    """``strongest`` of images of one array a row: (key, y, x, v, at) of each pixel.  Pixels do not leave their image's row; null ones count 0."""

    def kernel(image: np.ndarray, _key: object) -> list[tuple]:
        h, w = image.shape
        reach = max(max(abs(dy), abs(dx)) for taps in kernels for dy, dx in taps)
        ext = np.pad(image, reach)
        answers = [sum(weight * ext[reach + dy : reach + dy + h, reach + dx : reach + dx + w] for (dy, dx), weight in sorted(taps.items())) for taps in kernels]
        best, at = np.max(answers, axis=0), np.argmax(answers, axis=0)
        return [(y, x, best[y, x], at[y, x]) for y in range(h) for x in range(w)]

    whole = images.select(key, F.transform(values, lambda v: F.coalesce(v, F.lit(0.0))).alias(values))
    return per_image(whole, [values], [key], width, kernel, "y int, x int, v double, at int")


def above_percentile(px: DataFrame, key: str, share: float) -> DataFrame:
    """``px`` with hit: v above the image's exact linear percentile."""
    return px.withColumn("hit", F.col("v") > F.percentile("v", F.lit(share)).over(Window.partitionBy(key)))


def otsu(px: DataFrame, key: str, bins: int = 256) -> DataFrame:
    """(key, threshold): middle of the first of ``bins`` equal bins of [0, 1] that parts the values with the largest between-class variance."""
    place = F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).cast("int")
    counted = px.groupBy(key, place.alias("bin")).agg(F.count("*").cast("double").alias("n"))
    mid = (F.col("bin") + 0.5) / bins
    upto, every = Window.partitionBy(key).orderBy("bin"), Window.partitionBy(key)
    rows = counted.withColumn("m", F.col("n") * mid).withColumns({"below": F.sum("n").over(upto), "below_sum": F.sum("m").over(upto), "all": F.sum("n").over(every), "all_sum": F.sum("m").over(every)})
    gap = F.col("all_sum") * F.col("below") - F.col("below_sum") * F.col("all")
    between = F.coalesce(F.try_divide(gap * gap, F.nullif(F.col("below") * (F.col("all") - F.col("below")), F.lit(0.0))), F.lit(0.0))
    return rows.groupBy(key).agg(F.max_by(mid, F.struct(F.round(between, 9), -F.col("bin"))).alias("threshold"))


def plane(px: DataFrame, key: str) -> DataFrame:
    """(key, slope_x, slope_y, tilt): least-squares plane on a full grid, where x and y are uncorrelated."""
    return px.groupBy(key).agg(F.regr_slope("v", "x").alias("slope_x"), F.regr_slope("v", "y").alias("slope_y")).withColumn("tilt", F.hypot("slope_x", "slope_y"))


def circle(points: DataFrame, key: str) -> DataFrame:
    """(key, cx, cy, r): Kåsa's least-squares circle through (x, y) points, from centred moments."""
    m = points.join(points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my")), key).withColumns({"u": F.col("x") - F.col("mx"), "w": F.col("y") - F.col("my")})
    u, w = F.col("u"), F.col("w")
    sums = m.groupBy(key).agg(
        F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(u * u).alias("uu"), F.sum(u * w).alias("uw"), F.sum(w * w).alias("ww"),
        F.sum(u * (u * u + w * w)).alias("ur"), F.sum(w * (u * u + w * w)).alias("wr"),
    )
    det = F.nullif(2 * (F.col("uu") * F.col("ww") - F.col("uw") * F.col("uw")), F.lit(0.0))
    cu = F.try_divide(F.col("ur") * F.col("ww") - F.col("wr") * F.col("uw"), det)
    cw = F.try_divide(F.col("wr") * F.col("uu") - F.col("ur") * F.col("uw"), det)
    rows = sums.withColumns({"cu": cu, "cw": cw})
    return rows.select(key, (F.col("mx") + F.col("cu")).alias("cx"), (F.col("my") + F.col("cw")).alias("cy"), F.sqrt(F.col("cu") * F.col("cu") + F.col("cw") * F.col("cw") + (F.col("uu") + F.col("ww")) / F.col("n")).alias("r"))


def view_mask(px: DataFrame, key: str) -> DataFrame:
    """(key, pixels, cy, cx, rh, rv) of the lit pixels (column lit): centroid and half extents along its row and column; none gives radius 0."""
    lit = px.filter("lit")
    centre = lit.groupBy(key).agg(F.count("*").alias("pixels"), F.bround(F.avg("y")).cast("int").alias("cy"), F.bround(F.avg("x")).cast("int").alias("cx"))
    marked = lit.join(centre, key)
    extent = lambda axis, other: (F.max(F.when(F.col(other) == F.col(f"c{other}"), F.col(axis))) - F.min(F.when(F.col(other) == F.col(f"c{other}"), F.col(axis)))) / 2.0
    radii = marked.groupBy(key).agg(extent("x", "y").alias("rh"), extent("y", "x").alias("rv"))
    zero = {"pixels": 0, "rh": 0.0, "rv": 0.0}
    return px.select(key).distinct().join(centre, key, "left").join(radii, key, "left").fillna(zero)


def quadrant(x: Column, y: Column, axis: Column, cx: Column | float, cy: Column | float) -> Column:
    """0..3: quarter turns from the axis to the point about a centre."""
    turn = F.pmod(F.atan2(y - cy, x - cx) - axis, F.lit(2 * math.pi))
    return F.least(F.greatest(F.floor(turn / (math.pi / 2)), F.lit(0)), F.lit(3)).cast("int")


def region_minimum(px: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """(key, region, score): the least normed variance of the Laplacian over four corners and a centre that overlaps them."""
    y, x = F.col("y"), F.col("x")
    half, quarter = (height // 2, width // 2), (height // 4, width // 4)
    named = F.array(
        *(F.when(c, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("region"))) for i, (name, c) in enumerate((
            ("top_left", (y < half[0]) & (x < half[1])), ("top_right", (y < half[0]) & (x >= half[1])),
            ("bottom_left", (y >= half[0]) & (x < half[1])), ("bottom_right", (y >= half[0]) & (x >= half[1])),
            ("centre", y.between(quarter[0], height - quarter[0] - 1) & x.between(quarter[1], width - quarter[1] - 1)),
        )))
    )
    rows = laplacian(px, key).filter(F.col("lap").isNotNull()).select(key, "v", "lap", F.inline(F.array_compact(named)))
    scores = rows.groupBy(key, "ord", "region").agg(F.when(F.count("*") < 2, 0.0).otherwise(F.var_pop("lap") / F.pow(F.avg("v") + 1e-6, 2)).alias("score"))
    best = F.min(F.struct(F.round("score", 9).alias("r"), "ord", "region", "score"))
    return scores.groupBy(key).agg(best.alias("b")).select(key, "b.region", "b.score")


def nearest_distance(points: DataFrame, to: DataFrame, key: str) -> DataFrame:
    """(key, y, x, distance): from each point to the nearest of the image's ``to`` points; null without any."""
    other = to.select(key, F.col("y").alias("_y"), F.col("x").alias("_x"))
    gap = F.hypot(F.col("y") - F.col("_y"), F.col("x") - F.col("_x"))
    return points.select(key, "y", "x").join(other, key, "left").groupBy(key, "y", "x").agg(F.min(gap).alias("distance"))


def spectral_slope(px: DataFrame, key: str, size: int) -> DataFrame:
    """(key, slope): log-log slope of the radial power profile of the mean-free, Hann-weighted patch.

    The transform of a small patch is a sum over pixels for each of its size^2 frequencies.
    """
    hann = F.array(*(F.lit(0.5 - 0.5 * math.cos(2 * math.pi * k / (size - 1))) for k in range(size)))
    weight = F.get(hann, F.col("y")) * F.get(hann, F.col("x"))
    rows = px.withColumn("f", (F.col("v") - F.avg("v").over(Window.partitionBy(key))) * weight)
    waves = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-(size // 2), size // 2) for b in range(-(size // 2), size // 2)))
    turn = (F.col("a") * F.col("y") + F.col("b") * F.col("x")) * (2 * math.pi / size)
    power = rows.select(key, "y", "x", "f", F.inline(waves)).groupBy(key, "a", "b").agg((F.pow(F.sum(F.col("f") * F.cos(turn)), 2) + F.pow(F.sum(F.col("f") * F.sin(turn)), 2)).alias("p"))
    profile = power.withColumn("r", F.floor(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")))).groupBy(key, "r").agg(F.avg("p").alias("p")).filter("r >= 1 and p > 0")
    return profile.groupBy(key).agg(F.coalesce(F.regr_slope(F.log("p"), F.log("r")), F.lit(0.0)).alias("slope"))
