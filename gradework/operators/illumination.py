"""Illumination of an image: a plane and a radial polynomial by their normal equations, and the better of both.

Pixels are exploded where the image lies; the sums of an image are complete before anything is shuffled, so one
row an image moves.  Coordinates are taken from the middle of the pixels that count, which parts the plane's
slopes from its level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewer pixels than this have no fit.
LEAST_PIXELS = 10


def _middle(width: int, inside: str | None, values: str) -> tuple[Column, Column]:
    """Mean row and column of the pixels that count."""
    p = F.sequence(F.lit(0), F.size(values) - 1)
    if inside is not None:
        p = F.filter(p, lambda i: F.get(inside, i))
    n = F.nullif(F.size(p), F.lit(0))
    total = lambda part: F.aggregate(p, F.lit(0).cast("long"), lambda s, i: s + part(i))
    return total(lambda i: F.floor(i / width)) / n, total(lambda i: i % width) / n


def _determinant(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def illumination(images: DataFrame, key: str, values: str, width: int, inside: str | None = None) -> DataFrame:
    """One row an image: (key, pixels, plane_x, plane_y, plane_0, radial_2, radial_1, radial_0, plane_error, radial_error, model, tilt, falloff).

    The plane is plane_x * u + plane_y * w + plane_0 from the middle; the radial model is a polynomial of degree 2 in the
    distance over the largest one.  Errors are mean squares; model names the smaller, the plane if equal.  tilt and
    falloff are the plane's steepness and the slope of a straight radial line, both over a radius of the area's disc.
    ``inside`` is an array of booleans, all pixels if None.  Fits that the pixels do not determine are null.
    """
    cy, cx = _middle(width, inside, values)
    given = images.select(key, F.col(values).cast("array<double>").alias("_v"), *([F.col(inside).alias("_in")] if inside else []), cy.alias("_cy"), cx.alias("_cx"))
    cells = F.arrays_zip(F.col("_v"), *([F.col("_in")] if inside else []))
    px = given.select(key, "_cy", "_cx", F.posexplode(cells).alias("_p", "_c")).select(key, "_cy", "_cx", "_p", "_c.*")
    px = px.filter(F.col("_v").isNotNull() & (F.col("_in") if inside else F.lit(True)))
    px = px.withColumns({"_u": F.col("_p") % width - F.col("_cx"), "_w": F.floor(F.col("_p") / width) - F.col("_cy")}).withColumn("_r", F.hypot("_u", "_w"))
    u, w, r, v = (F.col(c) for c in ("_u", "_w", "_r", "_v"))
    products = {"u": u, "w": w, "uu": u * u, "uw": u * w, "ww": w * w, "uv": u * v, "wv": w * v, "v": v, "vv": v * v} | {f"r{k}": F.pow(r, F.lit(k)) for k in range(1, 5)} | {"rv": r * v, "r2v": r * r * v}
    sums = px.groupBy(key).agg(F.count("*").alias("n"), F.max("_r").alias("most"), *(F.sum(c).alias(name) for name, c in products.items()))

    s = {name: F.col(name) for name in (*products, "n", "most")}
    det = F.nullif(F.round(s["uu"] * s["ww"] - s["uw"] * s["uw"], 9), F.lit(0.0))
    plane_x, plane_y = F.try_divide(s["uv"] * s["ww"] - s["wv"] * s["uw"], det), F.try_divide(s["wv"] * s["uu"] - s["uv"] * s["uw"], det)
    plane_error = (s["vv"] - plane_x * s["uv"] - plane_y * s["wv"] - s["v"] * s["v"] / s["n"]) / s["n"]

    reach = s["most"] + 1e-6
    t = {k: s[f"r{k}"] / F.pow(reach, F.lit(k)) for k in range(1, 5)} | {0: s["n"].cast("double")}
    right = [s["r2v"] / (reach * reach), s["rv"] / reach, s["v"]]
    left = [[t[4], t[3], t[2]], [t[3], t[2], t[1]], [t[2], t[1], t[0]]]
    whole = F.nullif(F.round(_determinant(left), 9), F.lit(0.0))
    swapped = lambda j: [[right[i] if k == j else left[i][k] for k in range(3)] for i in range(3)]
    radial = [F.try_divide(_determinant(swapped(j)), whole) for j in range(3)]
    radial_error = (s["vv"] - sum((a * b for a, b in zip(radial[1:], right[1:])), radial[0] * right[0])) / s["n"]

    disc = F.sqrt(s["n"] / math.pi)
    spread = F.nullif(F.round(s["r2"] - s["r1"] * s["r1"] / s["n"], 9), F.lit(0.0))
    falloff = F.try_divide(s["rv"] - s["r1"] * s["v"] / s["n"], spread) * disc
    enough = s["n"] >= LEAST_PIXELS
    made = {"plane_x": plane_x, "plane_y": plane_y, "plane_0": s["v"] / s["n"]} | {f"radial_{2 - j}": c for j, c in enumerate(radial)} | {"plane_error": plane_error, "radial_error": radial_error, "tilt": F.hypot(plane_x, plane_y) * disc, "falloff": falloff}
    out = sums.select(key, s["n"].alias("pixels"), *(F.when(enough, c).alias(name) for name, c in made.items()))
    better = F.when(F.round("plane_error", 12) <= F.round("radial_error", 12), "plane").when(F.col("radial_error").isNotNull(), "radial")
    return out.withColumn("model", better)


def field(fitted: DataFrame, y: Column, x: Column, cy: Column, cx: Column, most: Column) -> Column:
    """The chosen model's value at a pixel, from the columns of ``illumination``."""
    u, w = x - cx, y - cy
    t = F.hypot(u, w) / (most + 1e-6)
    plane = F.col("plane_x") * u + F.col("plane_y") * w + F.col("plane_0")
    return F.when(F.col("model") == "plane", plane).otherwise(F.col("radial_2") * t * t + F.col("radial_1") * t + F.col("radial_0"))
