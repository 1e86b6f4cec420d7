"""Operator 5: n-gram Jaccard join by size-aware heavy-light search, and its connected components.

A document's set is its distinct word shingles.  Equal sets are one class from the start.  For every
shingle the number of classes that have it is counted over the corpus; shingles of one class only cannot
link anything.  Then, with t = 85 / 100 and |A| = n:

* light sets (n up to a boundary) meet by subsets: sets of sizes n and m link only if they share
  o = ceil(t (n + m) / (1 + t)) shingles, so every subset of o shared shingles is a key of (n, m);
* heavy sets meet by inverted lists of their n - ceil(t n) + 1 rarest shingles (ties by value), of which
  two sets that link have one in common; light sets large enough to link a heavy one are listed too.

The boundary is the largest size for which a set has no more subsets than its rarest shingles have list
entries, by the mean list length of this corpus.  Pairs that meet are verified exactly; a group of many
near copies is joined through hubs (see ``components``), and no pair between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, chain, documents, fresh, mix, stage, word_hashes
from .components import grouped_components
from .counting import MESSAGE, add_up, count_list, message_table, messages, sharded, statistics

SHINGLE = 4
#: Similarity from which two sets link, in hundredths.
PERCENT = 85
#: Bits of a shingle's hash by which it is counted; shingles that agree in them share a count, which only makes lists longer.
BITS = 44
MAX_LIGHT = 20


def least_overlap(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int, most: int) -> list[int]:
    """Sizes of light sets that can link a set of n, other than by equality."""
    return [m for m in range(1, most + 1) if least_overlap(n, m, percent) <= min(n, m) and not (n == m == least_overlap(n, m, percent))]


def light_boundary(mean_list: float, percent: int) -> int:
    best = 1
    for n in range(2, MAX_LIGHT + 1):
        subsets = sum(comb(n, least_overlap(n, m, percent)) for m in partners(n, percent, n + 4))
        listed = (n - -(-percent * n // 100) + 1) * mean_list
        if subsets > listed:
            break
        best = n
    return best


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one."""
    words, at = word_hashes(texts)
    runs = chain(words, size)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(chain(words[a:b], int(b - a)) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text, n, s1, s2): the size of the set and 128 bits of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), size)
            n = pa.array([len(x) for x in sets], pa.int64())
            s1 = np.array([x.sum() for x in map(mix, sets)], dtype=np.uint64).view(np.int64)
            s2 = np.array([mix(x + np.uint64(0x5851F42D4C957F2D)).sum() for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(s1), pa.array(s2)], names=["doc_id", "text", "n", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, n long, s1 long, s2 long")


_ENTRIES = "node long, n long, keys array<long>, reach array<long>, shingles array<long>"


def similar_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(row, doc_id, n_shingles, component_id) of every document.

    component_id is the smallest doc_id reachable by links, the document's own included.  Null and empty
    texts have empty sets, which link nothing; repeated rows, and rows without doc_id, are documents of
    their own; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ranges = buckets_for(spark)
    table = sharded(_signed(docs, size), "sets")
    classes = table.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("row", "shard")).alias("rep"), F.min("doc_id").alias("low"))
    classes = stage(classes.select("n", "s1", "s2", F.col("rep.row").alias("node"), F.col("rep.shard").alias("shard"), "low"), "classes")
    none = F.lit(None)
    chosen = classes.select("shard", F.lit(-1).cast("long").alias("range"), F.lit(0).alias("kind"), none.cast("binary").alias("keys"), none.cast("binary").alias("counts"), F.col("node").alias("row"))
    texts = table.select("shard", "row", "text")

    def own_sets(rows: pa.Table, told: pa.Table) -> tuple[list[int], list[np.ndarray]]:
        wanted = np.array([x for x in told["row"].to_pylist() if x >= 0], dtype=np.int64)
        order = np.argsort(rows["row"].to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        rows = rows.filter(pa.array(np.isin(rows["row"].to_numpy(), wanted)))
        return rows["row"].to_pylist(), shingle_sets(rows["text"], size)

    shift = np.uint64(64 - BITS)

    def ask(rows: pa.Table, told: pa.Table) -> pa.Table:
        _, sets = own_sets(rows, told)
        if not sets:
            return message_table([])
        keys, counts = np.unique(np.concatenate([np.unique(x >> shift) for x in sets]), return_counts=True)
        return message_table(list(messages(told["shard"][0].as_py(), 1, keys, [counts], ranges, BITS)))

    asked = texts.groupBy("shard").cogroup(chosen.groupBy("shard")).applyInArrow(ask, MESSAGE)
    answers = stage(add_up(asked), "shingle-counts")
    total, _, squares = statistics(answers).get(1, [1, 1, 1])
    light = light_boundary(max(1.0, squares / max(1, total)), percent)
    replies = answers.filter("shard >= 0").unionByName(chosen)

    def entries(rows: pa.Table, told: pa.Table) -> pa.Table:
        nodes, sets = own_sets(rows, told)
        out: tuple[list, ...] = ([], [], [], [], [])
        if sets:
            keys = np.unique(np.concatenate([x >> shift for x in sets]))
            parts = sorted((r, c) for r, k, c in zip(told["range"].to_pylist(), told["kind"].to_pylist(), told["counts"].to_pylist()) if k == 1)
            counts = np.concatenate([count_list(c)[0] for _, c in parts])
            for node, own in zip(nodes, sets):
                df = counts[np.searchsorted(keys, own >> shift)]
                made = list(_keys(own, df, light, percent))
                if made:
                    keys_of = np.array([k for k, _ in made], dtype=np.uint64).view(np.int64)
                    for column, value in zip(out, (node, len(own), keys_of, [r for _, r in made], own.view(np.int64))):
                        column.append(value)
        lists = pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int64(), lists, lists, lists)
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("node", "n", "keys", "reach", "shingles"), out, kinds)})

    listed = stage(texts.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(entries, _ENTRIES), "entries")
    members = listed.select("node", "n", F.inline(F.arrays_zip("keys", "reach"))).withColumnRenamed("keys", "group")
    sets = listed.select("node", "n", "shingles")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
        both = both.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.select("a", "b", "na", "nb", common.alias("common")).filter(F.col("common") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("common")))

    def feasible(one, other):
        return (one("n") <= other("reach")) & (other("n") <= one("reach")) & (F.least(one("n"), other("n")) * 100 >= F.greatest(one("n"), other("n")) * percent)

    labels = grouped_components(members, lambda nodes: verify, ("n", "reach"), feasible, central="reach")
    known = classes.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    lowest = known.groupBy("c").agg(F.min("low").alias("component_id"))
    of_class = known.join(lowest, "c").select("n", "s1", "s2", "component_id")
    rows = table.select("row", "doc_id", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left")
    return rows.select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _keys(own: np.ndarray, df: np.ndarray, light: int, percent: int) -> Iterator[tuple[int, int]]:
    """The groups in which a set meets others, each with the size of the largest set that can link it from there.

    If two sets have their first common shingle, by rarity, at places i and j, they share at most n - i and
    m - j; a set met at place i must thus be small enough for n - i to be an overlap that links.
    """
    n = len(own)
    if n <= light:
        shared = own[df > 1]
        for m in partners(n, percent, light):
            o = least_overlap(n, m, percent)
            if len(shared) >= o:
                subsets = np.array(list(combinations(shared.tolist(), o)), dtype=np.uint64)
                code = np.full(len(subsets), (min(n, m) << 20) + max(n, m), dtype=np.uint64)
                for k in range(o):
                    code = mix(code * np.uint64(0x9E3779B97F4A7C15) + subsets[:, k])
                yield from ((c, light) for c in code.tolist())
    if n > light or 100 * n >= percent * (light + 1):
        rarest = np.lexsort((own, df))[: n - -(-percent * n // 100) + 1]
        for i, k in enumerate(rarest.tolist()):
            if df[k] > 1:
                yield int(own[k]), (n - i) * (100 + percent) // percent - n


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each connected group: that with the smallest doc_id, rows without doc_id last.

    Every row is a document of its own, so of repeated rows, and of several rows that share a doc_id and are
    near copies, one stays.  Rows with empty sets stay, as they are linked with nothing.  An empty table
    gives no rows; other columns stay, whatever their names.
    """
    place = fresh(docs, "_place")
    rows = stage(docs.withColumn(place, F.monotonically_increasing_id()), "rows")
    groups = similar_groups(rows.select(F.col(place).alias("doc_id"), "text"), size, percent).select(F.col("doc_id").alias(place), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(place))).alias("first")
    stays = rows.select(place, "doc_id").join(groups, place).groupBy("component_id").agg(first).select(F.col(f"first.{place}").alias(place))
    return rows.join(stays, place, "left_semi").select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return similar_groups(documents(spark, sf_dir)).drop("row")


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
