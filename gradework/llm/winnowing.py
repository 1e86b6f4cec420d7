"""Operator 2 [native]: document fingerprints by winnowing.

Every run of ``K`` code points is hashed; of every ``W`` neighbouring hashes the smallest is kept, the
rightmost one among equals, with its position.  Two texts that share ``K + W - 1`` code points in a row
share a kept hash.  A text with fewer than ``W`` runs has one window; a text shorter than ``K`` is one
run; an empty text keeps nothing.

A kept hash is one long: 32 bits of hash, then 32 bits that fall as the position grows, so the minimum
of longs is the smallest hash and, among equals, the rightmost.  Minima of ``W`` longs come from minima
of 2, 4, 8, ... by overlap.  All of it is built-in functions on arrays inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

K = 12
W = 32  # a power of two
#: Neighbouring documents are brought together in ranges of so many ids.
SPAN = 512

_LOW = 4294967295
_HIGH = -4294967296


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """array<long> of the kept hashes of a text, by position."""
    if w & (w - 1):
        raise ValueError("the window must be a power of two")

    def hashes(binary: Column) -> Column:
        runs = (F.length(binary) / 4).cast("int") - (k - 1)
        each = lambda i: F.xxhash64(F.substring(binary, i * 4 + 1, F.lit(4 * k))).bitwiseAND(F.lit(_HIGH)).bitwiseOR(F.lit(_LOW) - i)
        whole = F.array(F.xxhash64(binary).bitwiseAND(F.lit(_HIGH)).bitwiseOR(F.lit(_LOW)))
        return F.when(runs >= 1, F.transform(F.sequence(F.lit(0), runs - 1), each)).when(F.length(binary) > 0, whole).otherwise(F.array().cast("array<long>"))

    def minima(values: Column) -> Column:
        def overlap(step: int):
            return lambda a: F.zip_with(F.slice(a, 1, F.size(a) - step), F.slice(a, 1 + step, F.size(a) - step), lambda x, y: F.when(x < y, x).otherwise(y))

        out, step = values, 1
        while step < w:
            out = _let(out, overlap(step))
            step *= 2
        return F.when(F.size(values) > w, F.array_distinct(out)).when(F.size(values) > 0, F.array(F.array_min(values))).otherwise(values)

    return _let(F.encode(text, "UTF-32"), lambda b: _let(hashes(b), minima))


def _moved(kept: Column, by: Column) -> Column:
    """The same hashes, ``by`` positions further on."""
    return F.transform(kept, lambda v: v - by)


def hash_set(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda v: F.shiftright(v, 32).cast("int")))


def positions(kept: Column) -> Column:
    return F.transform(kept, lambda v: F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW)))


def as_text(kept: Column) -> Column:
    """``hash@position`` in hexadecimal and decimal, joined by commas."""
    one = lambda v: F.concat(F.hex(F.shiftright(v, 32).bitwiseAND(F.lit(_LOW))), F.lit("@"), (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))).cast("string"))
    return F.array_join(F.transform(kept, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every).cast("double")


def _successors(keys: DataFrame, fanout: int = 4096) -> DataFrame:
    """(key, next_key) of distinct longs in ascending order, the first after the last; no task gets them all.

    Keys are ranked inside ranges of ``fanout`` values; only one key of each range is ordered globally.
    """
    ranged = keys.withColumn("_range", F.floor(F.col("key") / fanout))
    firsts = ranged.groupBy("_range").agg(F.min("key").alias("_first"))
    everything = Window.orderBy("_range")  # one row for each range of fanout * SPAN ids
    after = firsts.withColumn("_after", F.lead("_first").over(everything)).withColumn("_head", F.min("_first").over(Window.partitionBy()))
    inside = Window.partitionBy("_range").orderBy("key")
    return (
        ranged.withColumn("_next", F.lead("key").over(inside))
        .join(after.select("_range", F.coalesce("_after", "_head").alias("_after")), "_range")
        .select("key", F.coalesce("_next", "_after").alias("next_key"))
    )


def with_next(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, text, _last) grouped for ``lead``: each range of ids also has the first document of the next range.

    Texts move once.  Rows with ``_last`` are those extra ones.  A null id comes before all others.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("_range", F.coalesce(F.floor(F.col("doc_id") / span), F.lit(-(1 << 60))))
    firsts = base.groupBy(F.col("_range").alias("key")).agg(F.min(F.struct("doc_id", "text")).alias("_first"))
    links = _successors(firsts.select("key"))
    extra = links.join(firsts.withColumnRenamed("key", "next_key"), "next_key").select(
        F.col("_first.doc_id").alias("doc_id"), F.col("_first.text").alias("text"), F.col("key").alias("_range"), F.lit(True).alias("_last")
    )
    return base.withColumn("_last", F.lit(False)).unionByName(extra)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """One row a document: kept, edited_kept (array<long>), n_chars, edited_sha256, near_edited, near_next.

    The edited text has its last floor(n/4) code points replaced by the first of the next document by
    doc_id (ties by text; after the last, the first).  Null text is the empty text; repeated rows stay;
    an empty table gives no rows; other columns are ignored.

    A text's windows are those inside its unchanged head and those that reach into its tail, so the
    head's are computed once for both texts.
    """
    span = k + w - 1
    order = Window.partitionBy("_range").orderBy("_last", "doc_id", "text")
    n, q = F.col("n_chars"), F.col("_tail")
    rows = (
        with_next(docs)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("_tail", F.floor(F.col("n_chars") / 4).cast("int"))
        .withColumn("_next_text", F.lead("text").over(order))
    )
    head = F.expr("left(text, int(n_chars) - _tail)")
    whole = (n - q) < span
    last = F.lit(span - 1)
    rows = (
        rows.withColumn("_head", head)
        .withColumn("_new", F.when(F.col("_last"), F.lit("")).otherwise(F.expr("left(coalesce(_next_text, ''), _tail)")))
        .withColumn("edited_sha256", F.sha2(F.concat("_head", "_new"), 256))
        .withColumn("_base", F.when(whole, F.lit(0)).otherwise(n - q - last).cast("long"))
        .withColumn("_old_tail", F.when(whole, F.col("text")).otherwise(F.expr(f"substring(text, int(_base) + 1, _tail + {span - 1})")))
        .withColumn("_new_tail", F.when(whole, F.concat("_head", "_new")).otherwise(F.concat(F.expr(f"right(_head, {span - 1})"), F.col("_new"))))
        .withColumn("_head_kept", F.when(whole, F.array().cast("array<long>")).otherwise(winnow(F.col("_head"), k, w)))
    )
    none = F.array().cast("array<long>")

    def joined(tail: str) -> Column:
        reaches = whole | (F.length(tail) >= span)
        kept = F.when(reaches, _moved(winnow(F.col(tail), k, w), F.col("_base"))).otherwise(none)
        return F.array_union("_head_kept", kept)

    rows = rows.withColumn("kept", joined("_old_tail")).withColumn("edited_kept", joined("_new_tail"))
    rows = rows.select("doc_id", "text", "n_chars", "edited_sha256", "kept", "edited_kept", "_last", "_range")
    rows = rows.withColumn("_set", hash_set(F.col("kept"))).withColumn("_next_set", F.lead("_set").over(order)).filter(~F.col("_last"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "kept",
        "edited_kept",
        likeness(F.col("_set"), hash_set(F.col("edited_kept"))).alias("near_edited"),
        likeness(F.col("_set"), F.col("_next_set")).alias("near_next"),
    )


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return fingerprints(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("kept")).alias("fingerprint"), as_text(F.col("edited_kept")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


QUERIES = {"op2_winnowing": op2_winnowing}
