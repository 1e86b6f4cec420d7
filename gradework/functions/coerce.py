"""Coercion of text columns to numbers, as screening tables need it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for numbers in quality columns (fixed values).
WORDS = {"pass": 0.0, "false": 0.0, "no": 0.0, "borderline": 1.0, "true": 1.0, "yes": 1.0, "fail": 2.0}


def finite(value: Column, default: float = 0.0) -> Column:
    """``value`` with null, NaN and infinities replaced."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(value)


def to_number(text: Column) -> Column:
    """A double for any text: verdict words have values, what cannot be parsed is 0."""
    word = F.lower(F.trim(text))
    out = finite(word.try_cast("double"))
    for key, value in WORDS.items():
        out = F.when(word == key, F.lit(value)).otherwise(out)
    return F.when(text.isNull() | (word == ""), F.lit(0.0)).otherwise(out)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Rec. 601 luma."""
    return red * 0.299 + green * 0.587 + blue * 0.114


def saturation(red: Column, green: Column, blue: Column) -> Column:
    """(max - min) / max of the channels, 0 for black."""
    top = F.greatest(red, green, blue)
    return F.coalesce(F.try_divide(top - F.least(red, green, blue), F.when(top > 0, top)), F.lit(0.0))


def colour_ratio(a: Column, b: Column) -> Column:
    return a / (b + 1e-6)


def resolution(width: Column, height: Column) -> Column:
    """``WxH``, empty where either is missing."""
    return F.coalesce(F.concat(width.cast("string"), F.lit("x"), height.cast("string")), F.lit(""))


def joined_reasons(*reasons: tuple[Column, str]) -> Column:
    """Names of those conditions that hold, joined by bars."""
    return F.concat_ws("|", *(F.when(c, F.lit(name)) for c, name in reasons))
