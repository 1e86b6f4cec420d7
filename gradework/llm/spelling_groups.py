"""Operator 13: spelling variants by wildcard groups, without pairs of words.

Two words that differ in one replaced code point share the rest: (position, prefix, suffix).  A group of
such words holds at most one word for each letter of the alphabet, ``ALPHABET`` code points in all, so it is
small whatever the corpus; it keeps its size and its two commonest words.  A word has, at that position,
size - 1 near words, and the commonest of them is the group's first word, or its second where the word is
the first.  Words with one code point less are found by joining each word's deletions with the vocabulary;
a word has at most as many of these as it has code points.  Numbers and best words of all positions and
deletions are then added up by word.

A word's form is at least ``RATIO`` times as frequent as the word, so a chain of forms has at most
log(occurrences) / log(RATIO) links; pointers are doubled until no root changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stage

#: Fixed values of the contract.
RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
NOISE = 199

#: Code points that a word can have: a-z and U+00C0 to U+00FF.
ALPHABET = 26 + 64


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word) of every run of letters that is long enough, with the contract's deletions.

    Null texts have no words, a null doc_id counts as the empty string; repeated rows count again.  Runs below
    ``min_length`` are left out before their hash is taken, as a deletion only shortens them.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).filter(F.length("run") >= min_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    hit = F.when(h % NOISE == 0, at)
    word = F.when(F.col("at").isNull(), F.col("run")).otherwise(cut)
    return each.withColumn("at", hit).select(word.alias("word")).filter(F.length("word") >= min_length)


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n) of words with at least ``min_count`` occurrences in all texts."""
    return occurrences(docs, min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _better(n: Column, word: Column) -> Column:
    """Orders near words: the most frequent is the least, ties by code point."""
    return F.struct((-n).alias("less"), word.alias("word"))


def replacements(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word and position with other words in the group, how many and which is the commonest."""
    spot = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("position"))
    keyed = spot.select(
        "word", "n", "position",
        F.expr("substring(word, 1, position - 1)").alias("prefix"),
        F.expr("substring(word, position + 1)").alias("suffix"),
    )
    group = Window.partitionBy("position", "prefix", "suffix")
    ordered = group.orderBy(F.desc("n"), "word")
    top = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct("word", "n")
    held = keyed.select(
        "word", "n",
        F.count("*").over(group).alias("size"),
        F.nth_value(own, 1).over(top).alias("first"),
        F.nth_value(own, 2).over(top).alias("second"),
    ).filter("size > 1")
    best = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    return held.withColumn("other", best).select("word", (F.col("size") - 1).alias("n_near"), _better(F.col("other.n"), F.col("other.word")).alias("best"))


def indels(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n_near, best) from each word's deletions that are words, for the longer word and for the shorter one."""
    # A repeated letter gives the same deletion at each of its places; the last of them stands for all.
    spot = words.filter(F.length("word") > min_length).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("position"))
    last = F.expr("substring(word, position, 1) <> substring(word, position + 1, 1)")
    shorter = spot.filter(last).select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.expr("concat(substring(word, 1, position - 1), substring(word, position + 1))").alias("word"))
    met = shorter.join(words, "word")
    return met.select(
        F.explode(
            F.array(
                F.struct(F.col("long").alias("word"), _better(F.col("n"), F.col("word")).alias("best")),
                F.struct(F.col("word").alias("word"), _better(F.col("long_n"), F.col("long")).alias("best")),
            )
        ).alias("x")
    ).select("x.word", F.lit(1).cast("long").alias("n_near"), "x.best")


def forms(words: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n, n_near, form, form_n) of each (word, n)."""
    near = replacements(words).unionByName(indels(words, min_length)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    n_best = -F.col("best.less")
    strong = n_best >= ratio * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.word")).alias("form"),
        F.when(strong, n_best).alias("form_n"),
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed`` with ``root``: from the word, forms are followed to the last."""
    links = stage(formed.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        # What a root points at itself; each round doubles the links that a pointer has gone.
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = links.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        links = stage(moved, "spelling-roots")
        still = not links.filter("moved").isEmpty()
        links = links.drop("moved")
        if not still:
            break
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_groups(docs: DataFrame, min_count: int = MIN_COUNT, min_length: int = MIN_LENGTH, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (doc_id, text, ...).

    Texts are handled as ``occurrences`` says; of near words with equal counts the smallest in code-point order
    is the form; an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    words = stage(vocabulary(docs.select("doc_id", "text"), min_count, min_length), "spelling-words")
    formed = stage(forms(words, ratio, min_length), "spelling-forms")
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus."""
    return spelling_groups(documents(spark, sf_dir))


QUERIES = {"op13_spelling_groups": op13_spelling_groups}
