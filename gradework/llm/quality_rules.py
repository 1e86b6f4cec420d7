"""Operator 12: quality rules, learned as an ordered decision list of threshold conjunctions.

``measure`` counts, for every whole text, what rules speak of; counting runs over Arrow batches.  ``learn``
grows and prunes rules by sequential covering (Cohen's RIPPER without its last optimisation): a rule grows on two
thirds of the labelled rows by the condition of largest FOIL gain until it covers no good row, loses from
its end what does not pay on the other third, and takes its rows with it.  ``decide`` writes the list as one
Spark expression of ``when`` clauses in the order in which the rules were found.

Bound: rules are learned from at most ``MAX_LABELLED`` labelled rows, chosen by a hash of doc_id; the
statistics of every document are counted over its whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _INVERSE, _BASE, _powers, _random_table, _slice_hashes, _SPACE, buffers, chain, documents, fresh, mix

#: Labelled rows that rules are learned from, at most.
MAX_LABELLED = 20_000
MAX_RULES = 24
MAX_CONDITIONS = 6
#: A rule stays if at least this share of the pruning rows that it covers is bad.
MIN_PRECISION = 0.6

#: Fixed values of the base rule.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
WINDOW = 5

_SLICE = 1 << 20
_RAW = _random_table(23)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_shouts", "n_stops", "n_marked", "n_doubled")
STATISTICS = "struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ">"


def _is(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(characters.encode())] = 1
    return out


_KINDS = {
    "n_symbols": _is(SYMBOLS),
    "n_upper": _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "n_lower": _is("abcdefghijklmnopqrstuvwxyz"),
    "n_digits": _is("0123456789"),
    "n_shouts": _is("!?"),
    "n_stops": _is(".,;:"),
}
_HEAD = np.ones(256, dtype=np.int64)  # bytes that begin a code point
_HEAD[0x80:0xC0] = 0


def _covered(keys: np.ndarray, n_words: int) -> np.ndarray:
    """Whether each word lies in a window whose key occurs twice or more; a window without a key has 0."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    at = np.flatnonzero((counts[inverse] > 1) & (keys != 0))
    steps = np.bincount(at, minlength=n_words + 1) - np.bincount(at + WINDOW, minlength=n_words + 1)[: n_words + 1]
    return np.cumsum(steps)[:n_words] > 0


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _slice_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n_texts, n = len(offsets) - 1, len(data)
    hashes, words, starts, ends = _slice_hashes(data, offsets, _RAW)
    text_of = np.repeat(np.arange(n_texts), np.diff(words))
    out = {name: _sums(kind[data], offsets) for name, kind in _KINDS.items()}
    out["n_words"] = np.diff(words)
    black = ~_SPACE[data]
    out["word_chars"] = _sums(_HEAD[data] * black, offsets)

    # Words in windows that come again in their text.
    runs = chain(hashes, WINDOW)
    keys = mix(runs + text_of[: len(runs)].astype(np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    keys[text_of[: len(runs)] != text_of[WINDOW - 1 :]] = 0
    out["n_repeat_words"] = _sums(_covered(keys, len(hashes)).astype(np.int64), words)

    # Words that end in a sign, and words that are the one before them.
    last = data[ends - 1] if len(ends) else data[:0]
    out["n_marked"] = _sums((_KINDS["n_symbols"] + _KINDS["n_shouts"])[last], words)
    same = np.zeros(len(hashes), dtype=np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
    out["n_doubled"] = _sums(same, words)

    # Lines with a word, and those that equal an earlier one of their text.
    breaks = np.flatnonzero(data == 10)
    of_break = np.searchsorted(offsets, breaks, side="right") - 1
    begin = np.concatenate([offsets[:-1], breaks + 1])
    stop = np.concatenate([breaks, offsets[1:]])
    of = np.concatenate([np.arange(n_texts), of_break])
    begin = begin[np.lexsort((begin, of))]
    stop = stop[np.lexsort((stop, np.concatenate([of_break, np.arange(n_texts)])))]
    of = np.sort(of)
    seen = np.concatenate([[0], np.cumsum(black)])
    full = seen[stop] > seen[begin]
    begin, stop, of = begin[full], stop[full], of[full]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_RAW[data] * _powers(_BASE, n)[:n], out=sums[1:])
    lines = mix((sums[stop] - sums[begin]) * _powers(_INVERSE, n + 1)[begin])
    lines = mix(lines + of.astype(np.uint64) * np.uint64(_BASE))
    out["n_lines"] = np.bincount(of, minlength=n_texts)
    _, first = np.unique(lines, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[first], minlength=n_texts)
    return out


def statistics(texts: pa.Array) -> pa.StructArray:
    """The counts of each text as a struct; null is the empty text."""
    data, offsets = buffers(texts)
    parts = []
    i, last = 0, len(offsets) - 1
    while i < last:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, side="right")) - 1)
        parts.append(_slice_statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        i = j
    columns = [np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c in _COUNTS]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(_COUNTS))


def measure(docs: DataFrame, text: str = "text", column: str = "_statistics") -> DataFrame:
    """``docs`` with ``column``, the counts of each text.

    Null and empty texts count nothing; each row, repeated ones and those without doc_id included, is counted
    by itself; an empty table gives no rows; all other columns stay.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield statistics(texts)

    # Given as values, as this module's annotations are text at run time.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(column, F.arrow_udf(run, STATISTICS)(F.col(text)))


def features(column: str = "_statistics") -> dict[str, Column]:
    """Name -> double that a rule may speak of; 0 where there is nothing to divide by."""
    own = {c: F.col(f"{column}.{c}") for c in _COUNTS}

    def share(a: str, b: Column) -> Column:
        return F.when(b > 0, own[a] / b).otherwise(F.lit(0.0))

    letters = own["n_upper"] + own["n_lower"]
    return {
        "symbols_per_word": share("n_symbols", own["n_words"]),
        "shouts_per_word": share("n_shouts", own["n_words"]),
        "stops_per_word": share("n_stops", own["n_words"]),
        "marked_share": share("n_marked", own["n_words"]),
        "doubled_share": share("n_doubled", own["n_words"]),
        "repeat_share": share("n_repeat_words", own["n_words"]),
        "chars_per_word": share("word_chars", own["n_words"]),
        "dup_line_share": share("n_dup_lines", own["n_lines"]),
        "words_per_line": share("n_words", own["n_lines"]),
        "upper_share": share("n_upper", letters),
        "digit_share": share("n_digits", own["word_chars"]),
        "letter_share": F.when(own["word_chars"] > 0, letters / own["word_chars"]).otherwise(F.lit(0.0)),
    }


FEATURES = tuple(
    "symbols_per_word shouts_per_word stops_per_word marked_share doubled_share repeat_share chars_per_word dup_line_share words_per_line upper_share digit_share letter_share".split()
)


class Condition(NamedTuple):
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: float

    def holds(self, rows: np.ndarray) -> np.ndarray:
        values = rows[:, FEATURES.index(self.feature)]
        return values >= self.threshold if self.above else values < self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, rows: np.ndarray) -> np.ndarray:
    out = np.ones(len(rows), dtype=bool)
    for c in rule:
        out &= c.holds(rows)
    return out


def _best_condition(rows: np.ndarray, bad: np.ndarray) -> Condition | None:
    """The condition of largest FOIL gain; ties go to the feature that comes first, then to "above", then to the lower threshold."""
    p0, n = int(bad.sum()), len(bad)
    best, found = 1e-9, None
    base = math.log2(p0 / n)
    for k, name in enumerate(FEATURES):
        order = np.argsort(rows[:, k], kind="stable")
        values, marks = rows[order, k], bad[order]
        cuts = np.flatnonzero(values[1:] > values[:-1]) + 1  # rows before a cut are below the threshold
        if not len(cuts):
            continue
        below = np.concatenate([[0], np.cumsum(marks)])[cuts]
        for above, p, all_rows in ((True, p0 - below, n - cuts), (False, below, cuts)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / all_rows) - base), -1.0)
            at = int(np.argmax(gain))
            if gain[at] > best:
                low, high = values[cuts[at] - 1], values[cuts[at]]
                middle = float((low + high) / 2)
                best, found = gain[at], Condition(name, above, middle if low < middle else float(high))
    return found


def grow(rows: np.ndarray, bad: np.ndarray) -> Rule:
    """Conditions added by gain until no good row is covered."""
    rule: list[Condition] = []
    while bad.any() and not bad.all() and len(rule) < MAX_CONDITIONS:
        condition = _best_condition(rows, bad)
        if condition is None:
            break
        rule.append(condition)
        held = condition.holds(rows)
        rows, bad = rows[held], bad[held]
    return tuple(rule)


def prune(rule: Rule, rows: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule with the largest (bad - good) / (bad + good) on ``rows``; ties go to the shorter one."""
    best, kept = -2.0, rule
    for k in range(1, len(rule) + 1):
        held = covers(rule[:k], rows)
        n, p = int(held.sum()), int(bad[held].sum())
        worth = (2 * p - n) / n if n else -1.0
        if worth > best:
            best, kept = worth, rule[:k]
    return kept


def cover(rows: np.ndarray, bad: np.ndarray, growing: np.ndarray, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """The decision list from feature rows, whether each is bad, and whether it belongs to the growing rows."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and bad[growing].any() and not bad[growing].all():
        rule = grow(rows[growing], bad[growing])
        if not rule:
            break
        rule = prune(rule, rows[~growing], bad[~growing])
        held = covers(rule, rows)
        judged = held & ~growing if (held & ~growing).any() else held
        if bad[judged].mean() < min_precision:
            break
        rules.append(rule)
        rows, bad, growing = rows[~held], bad[~held], growing[~held]
    return rules


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Rules for quality 0 from documents (doc_id, text) and labels (doc_id, quality), at most ``max_rows`` of them by hash.

    Labels without a quality and rows without doc_id teach nothing; a document with several labels counts once for
    each.  Without rows of both kinds there is no rule, and every document that passes the base rule is kept.
    """
    known = labels.filter(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("order"))
    n = known.count()
    space = 1 << 20
    share = min(space, int(space * max_rows / max(n, 1)) + 1)
    sample = known.filter(F.pmod(F.col("order"), F.lit(space)) < share).orderBy("order", "quality").limit(max_rows)
    stated = measure(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    own = features()
    got = stated.select("order", "quality", *(own[name].alias(name) for name in FEATURES)).collect()
    if not got:
        return []
    got.sort(key=tuple)
    rows = np.array([r[2:] for r in got], dtype=np.float64)
    bad = np.array([r["quality"] == 0 for r in got])
    growing = np.array([(r["order"] >> 24) % 3 != 0 for r in got])
    return cover(rows, bad, growing, min_precision)


def stated(rules: list[Rule]) -> list[str]:
    """The rules in words."""
    return [" and ".join(f"{c.feature} {'>=' if c.above else '<'} {c.threshold!r}" for c in rule) for rule in rules]


def decide(rules: list[Rule], column: str = "_statistics") -> Column:
    """The number, from 1, of the first rule that a row meets; null where none does."""
    own = features(column)
    out: Column | None = None
    for k, rule in enumerate(rules):
        met: Column | None = None
        for c in rule:
            one = own[c.feature] >= F.lit(c.threshold) if c.above else own[c.feature] < F.lit(c.threshold)
            met = one if met is None else met & one
        out = F.when(met, F.lit(k + 1)) if out is None else out.when(met, F.lit(k + 1))
    return F.lit(None).cast("int") if out is None else out


def base_failed(column: str = "_statistics") -> Column:
    n, again = F.col(f"{column}.n_words"), F.col(f"{column}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", column: str = "_quality") -> DataFrame:
    """``docs`` with ``column``, a struct of the counts, base_failed, rule (the first rule met, or null) and kept.

    Rows are judged as ``measure`` counts them: null and empty texts fail the base rule and are not kept.
    """
    counts = fresh(docs, "_statistics")
    rule = decide(rules, counts)
    failed = base_failed(counts)
    fields = [F.col(f"{counts}.{c}").alias(c) for c in _COUNTS]
    verdict = F.struct(*fields, failed.alias("base_failed"), rule.alias("rule"), (~failed & rule.isNull()).alias("kept"))
    return measure(docs, text, counts).withColumn(column, verdict).drop(counts)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the rule of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = judge(docs, rules)
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return judged.select("doc_id", *(F.col(f"_quality.{c}").alias(c) for c in shown))


QUERIES = {"op12_quality_rules": op12_quality_rules}
