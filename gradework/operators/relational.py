"""Joins of screening tables: overlays, lookups with a default, merges, precedence, resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlay(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the values of ``over`` where it has some; other rows keep their own."""
    marked = over.select(key, *(F.col(c).alias(f"_over_{c}") for c in columns))
    out = base.join(marked, key, "left")
    return out.withColumns({c: F.coalesce(f"_over_{c}", c) for c in columns}).drop(*(f"_over_{c}" for c in columns))


def lookup(df: DataFrame, table: DataFrame, key: str, values: list[str], default_key: str, constants: dict[str, float] | None = None) -> DataFrame:
    """``df`` with values by key; else those of the row ``default_key``; else constants.

    Equal keys in ``table`` must not repeat.  The table is joined by its key twice and left to the
    planner to broadcast, by its size.
    """
    exact = table.select(key, *(F.col(v).alias(f"_own_{v}") for v in values))
    pooled = table.filter(F.col(key) == default_key).select(F.lit(1).alias("_all"), *(F.col(v).alias(f"_pool_{v}") for v in values))
    out = df.withColumn("_all", F.lit(1)).join(exact, key, "left").join(pooled, "_all", "left")
    last = {v: F.lit((constants or {}).get(v)) for v in values}
    out = out.withColumns({v: F.coalesce(F.col(f"_own_{v}"), F.col(f"_pool_{v}"), last[v]) for v in values})
    return out.drop("_all", *(f"_own_{v}" for v in values), *(f"_pool_{v}" for v in values))


def one_per_key(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in an explicit order."""
    rank = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(rank)).filter("_nth = 1").drop("_nth")


def merge(left: DataFrame, right: DataFrame, key: str, *order) -> DataFrame:
    """Left join with one right row a key; right columns replace left ones, and the row count stays."""
    once = one_per_key(right, key, *order)
    own = [c for c in left.columns if c == key or c not in right.columns]
    return left.select(*own).join(once, key, "left")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key is not among what is done."""
    return work.join(done.select(key), key, "left_anti")


def available(work: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return work.join(cached.select(key), key, "left_semi")


def best_match(items: DataFrame, candidates: list[tuple[DataFrame, str]], key: str, target: str) -> DataFrame:
    """(key, target, rule): candidates are (matches of (key, target), rule name), the strongest rule first; none gives null."""
    ranked = None
    for place, (found, rule) in enumerate(candidates):
        rows = found.select(key, target, F.lit(place).alias("_place"), F.lit(rule).alias("rule"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    best = ranked.groupBy(key).agg(F.min(F.struct("_place", target, "rule")).alias("_best"))
    return items.select(key).join(best, key, "left").select(key, F.col(f"_best.{target}").alias(target), F.col("_best.rule").alias("rule"))


def weak_labels(candidates: DataFrame, images: DataFrame, key: str, grade: str) -> DataFrame:
    """Candidates with weak_label: 0 on images of grade 0, 1 on grades 3 and 4; others are left out."""
    label = F.when(F.col(grade) == 0, 0).when(F.col(grade).isin(3, 4), 1)
    return candidates.join(images.select(key, label.alias("weak_label")), key).filter(F.col("weak_label").isNotNull())


def worst_eye(eyes: DataFrame, person: str, eye: str, grade: str) -> DataFrame:
    """(person, worst_eye, worst_grade, referable): the highest grade of a person, the first eye among equals."""
    best = F.max_by(F.struct(eye, grade), F.struct(F.col(grade), -F.col(eye)))
    return eyes.groupBy(person).agg(best.alias("_b"), F.max((F.col(grade) >= 2).cast("int")).alias("referable")).select(person, F.col(f"_b.{eye}").alias("worst_eye"), F.col(f"_b.{grade}").alias("worst_grade"), "referable")


def dataset(features: DataFrame, labels: DataFrame, splits: DataFrame, key: str, carried: list[str], verdict: str | None = None) -> DataFrame:
    """Features with diagnosis and the carried columns of the splits; what an image does not have is the empty text.

    Images that ``verdict`` rejects ("fail") are dropped, all others stay, once for each row of features.  Labels and splits have a row a key at most.
    """
    rows = features if verdict is None else features.filter(F.coalesce(F.lower(F.trim(verdict)), F.lit("")) != "fail")
    text = lambda df, columns: df.select(key, *(F.col(c).cast("string").alias(c) for c in columns))
    out = rows.join(text(labels, ["diagnosis"]), key, "left").join(text(splits, carried), key, "left")
    return out.fillna("", ["diagnosis", *carried])


def backfilled(df: DataFrame, more: DataFrame, key: str, after: str) -> DataFrame:
    """``df`` with the columns of ``more`` (a row a key) behind the column ``after``; unmatched rows have the empty text, and the row count stays."""
    added = [c for c in more.columns if c != key]
    clash = [c for c in added if c in df.columns]
    if clash or after not in df.columns:
        raise ValueError(f"cannot add {added} behind {after}: {clash or 'no such column'}")
    at = df.columns.index(after) + 1
    joined = df.join(more.select(key, *(F.col(c).cast("string").alias(c) for c in added)), key, "left").fillna("", added)
    return joined.select(*df.columns[:at], *added, *df.columns[at:])


def measurable(images: DataFrame, key: str, wanted: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Images whose view was found and not rejected, of a list of keys if given, the first ``limit`` by key if asked for."""
    rows = images.filter((F.col("fov_ok") == 1) & (F.col("gate_reject") == 0))
    if wanted is not None:
        rows = rows.join(wanted.select(key).distinct(), key, "left_semi")
    return rows if limit is None else rows.orderBy(key).limit(limit)
