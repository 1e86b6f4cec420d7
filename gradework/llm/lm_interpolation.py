"""Operator 4: language-model scores by deleted interpolation.

Trigram, bigram and unigram estimates are mixed with weights that depend on how often the longest known
context was seen, in buckets of powers of two.  A part of the training documents is deleted: the others'
counts give estimates of its tokens, and expectation-maximisation finds each bucket's weights from them.
The final estimates use the counts of all training documents.

All counts are over the whole corpus.  Words are 64-bit hashes; runs of two and three are counted by 42
bits.  Expectation-maximisation works on counts of cells, tokens of one bucket whose three estimates
agree to a tenth of a decade, so the driver sees a bounded table at any input size.

The text is lower-cased in A-Z; tokens are the words between spaces, then one end.  Before the first word
stands a beginning, which is a context but no token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, crc_mod, documents, mix, stage, word_hashes
from .counting import MESSAGE, add_up, count_list, message_table, messages, sharded, statistics

_END = np.uint64(0x1D8AF066F1D1E5C3)
_BEGIN = np.uint64(0x7C3E6B2A9D4F8B11)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_RUN_BITS = 48
SHARD_DOCS = 2048
#: The unigrams' weight never falls below it, so an n-gram that was never seen has a probability in every bucket.
LEAST_WEIGHT = 1e-4
_LEVELS = 24  # context buckets of a trigram context; as many follow for a bigram context
_STEPS = 10  # cells a decade
ITERATIONS = 60


class _Shard:
    """Tokens of a shard's documents and their n-gram keys."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows["row"].to_numpy(), kind="stable")
        self.rows = rows = rows.take(pa.array(order))
        words, at = word_hashes(rows["text"])
        n = rows.num_rows
        doc = np.repeat(np.arange(n), np.diff(at))
        self.starts = at[:-1] + np.arange(n)
        ends = at[1:] + np.arange(n)
        tokens = np.empty(len(words) + n, dtype=np.uint64)
        tokens[np.arange(len(words)) + doc] = words
        tokens[ends] = _END
        self.doc = np.repeat(np.arange(n), np.diff(at) + 1)
        self.first = np.zeros(len(tokens), dtype=bool)
        self.first[self.starts] = True
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = _BEGIN
        pairs = mix(before * _FACTOR + tokens)
        triples = np.empty_like(tokens)
        triples[1:] = mix(pairs[:-1] * _FACTOR + tokens[1:])
        shift = np.uint64(64 - _RUN_BITS)
        # The distinct keys of each order, and each token's place among them; a first token has no trigram.
        self.keys, self.places = [], []
        for values in (tokens, pairs >> shift, (triples >> shift)[~self.first]):
            keys, places = np.unique(values, return_inverse=True)
            self.keys.append(keys)
            self.places.append(places)
        self.end_place = int(np.searchsorted(self.keys[0], _END)) if n else 0

    def counts(self, weights: np.ndarray) -> list[np.ndarray]:
        """Of each order's keys, over the tokens of documents with a weight of 1."""
        own = weights[self.doc]
        return [np.bincount(p, w, len(k)).astype(np.uint64) for p, w, k in zip(self.places, (own, own, own[~self.first]), self.keys)]

    def estimates(self, told: pa.Table, which: int, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(p3, p2, p1, bucket, unigram count) of every token, by the first (deleted part left out) or second counts."""
        parts = sorted((k, r, c) for k, r, c in zip(told["kind"].to_pylist(), told["range"].to_pylist(), told["counts"].to_pylist()))
        answers = [np.concatenate([count_list(c)[which] for k, _, c in parts if k == order + 1] or [np.zeros(0, np.uint64)]).astype(np.float64) for order in range(3)]
        one, two = answers[0][self.places[0]], answers[1][self.places[1]]
        three = np.zeros(len(one))
        three[~self.first] = answers[2][self.places[2]]
        documents = answers[0][self.end_place]  # as many as ends
        context1 = np.empty_like(one)
        context1[1:] = one[:-1]
        context1[self.starts] = documents
        context2 = np.zeros_like(one)
        context2[1:] = two[:-1]
        context2[self.starts] = 0
        p1 = (one + 0.5) / (total + 0.5 * (distinct + 1))
        p2 = np.divide(two, context1, out=np.zeros_like(two), where=context1 > 0)
        p3 = np.divide(three, context2, out=np.zeros_like(three), where=context2 > 0)
        level = lambda c: np.minimum(_LEVELS - 1, np.log2(np.maximum(c, 1)).astype(np.int64) + (c > 0))
        bucket = np.where(context2 > 0, level(context2), _LEVELS + level(context1))
        return p3, p2, p1, bucket, one


def fit_weights(cells: list[tuple[int, int, int, int, int]], iterations: int = ITERATIONS) -> np.ndarray:
    """Weights of (trigram, bigram, unigram) for each bucket, from (bucket, q3, q2, q1, n) cells by expectation-maximisation."""
    weights = np.tile([0.0, 0.0, 1.0], (2 * _LEVELS, 1))
    data = np.array(list(cells), dtype=np.float64).reshape(-1, 5)
    for b in np.unique(data[:, 0]).astype(int):
        own = data[data[:, 0] == b]
        p = np.where(own[:, 1:4] < 0, 0.0, 10.0 ** (-own[:, 1:4] / _STEPS))
        n = own[:, 4]
        w = np.full(3, 1 / 3)
        for _ in range(iterations):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
        w[2] = max(w[2], LEAST_WEIGHT)
        weights[b] = w / w.sum()
    return weights


def score(docs: DataFrame, training: Column, deleted: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document.

    training and deleted are boolean columns of docs: the model learns from training documents, and its
    weights from those of them that are deleted.  Null text is the empty text, of one token; repeated rows,
    and rows without doc_id, are documents of their own; an empty table gives no rows; without training
    documents both scores are those of a uniform model over one word; other columns are ignored.
    """
    spark = docs.sparkSession
    ranges = buckets_for(spark)
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = docs.select("doc_id", "text", flag(training).alias("train"), (flag(training) & flag(deleted)).alias("apart"))
    table = sharded(rows, "lm", apart="apart", size=SHARD_DOCS)

    def ask(rows: pa.Table) -> pa.Table:
        shard = _Shard(rows)
        train = shard.rows["train"].to_numpy(zero_copy_only=False).astype(np.float64)
        kept = train * ~shard.rows["apart"].to_numpy(zero_copy_only=False)
        number = rows["shard"][0].as_py()
        out = []
        for order, (keys, main, every) in enumerate(zip(shard.keys, shard.counts(kept), shard.counts(train))):
            out += messages(number, order + 1, keys, [main, every], ranges, _RUN_BITS if order else 64)
        return message_table(out)

    asked = table.select("shard", "row", "text", "train", "apart").groupBy("shard").applyInArrow(ask, MESSAGE)
    answers = stage(add_up(asked), "ngram-counts")
    found = statistics(answers).get(1, np.zeros(6, np.int64))
    totals = [(int(found[3 * i]), int(found[3 * i + 1])) for i in range(2)]  # tokens, distinct: without the deleted part, with it
    replies = answers.filter("shard >= 0").select("shard", "range", "kind", "counts")

    def cells(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("bucket", "q3", "q2", "q1", "n")})
        p3, p2, p1, bucket, _ = _Shard(rows).estimates(told, 0, *totals[0])
        steps = [np.where(p > 0, np.rint(-np.log10(np.where(p > 0, p, 1)) * _STEPS), -1).astype(np.int64) for p in (p3, p2, p1)]
        code = ((bucket * 1024 + steps[0] + 1) * 1024 + steps[1] + 1) * 1024 + steps[2] + 1
        code, n = np.unique(code, return_counts=True)
        columns = [code >> 30, (code >> 20 & 1023) - 1, (code >> 10 & 1023) - 1, (code & 1023) - 1, n]
        return pa.table({k: pa.array(c.astype(np.int64)) for k, c in zip(("bucket", "q3", "q2", "q1", "n"), columns)})

    texts = table.select("shard", "row", "text")
    apart = texts.filter("shard % 2 = 1").groupBy("shard").cogroup(replies.filter("shard % 2 = 1").groupBy("shard"))
    counted = apart.applyInArrow(cells, "bucket long, q3 long, q2 long, q1 long, n long").groupBy("bucket", "q3", "q2", "q1").agg(F.sum("n").alias("n"))

    def fit(cells: pa.Table) -> pa.Table:
        bucket = cells["bucket"][0].as_py()
        w = fit_weights(zip(*(cells[c].to_pylist() for c in ("bucket", "q3", "q2", "q1", "n"))))[bucket]
        return pa.table({"bucket": [bucket], "w": [w.tolist()]})

    weights = np.tile([0.0, 0.0, 1.0], (2 * _LEVELS, 1))
    for r in counted.groupBy("bucket").applyInArrow(fit, "bucket long, w array<double>").collect():  # a row for each bucket
        weights[r["bucket"]] = r["w"]
    tokens, distinct = totals[1]

    def final(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        shard = _Shard(rows)
        p3, p2, p1, bucket, one = shard.estimates(told, 1, tokens, distinct)
        w = weights[bucket]
        mixed = np.log10(w[:, 0] * p3 + w[:, 1] * p2 + w[:, 2] * p1)
        per = lambda x: np.add.reduceat(x, shard.starts)
        n = np.bincount(shard.doc)
        return pa.table({"row": shard.rows["row"], "n_tokens": n.astype(np.int64), "n_known": per((one > 0).astype(np.int64)), "base_score": per(np.log10(p1)), "score": per(mixed)})

    scored = texts.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(final, "row long, n_tokens long, n_known long, base_score double, score double")
    return table.select("row", "doc_id").join(scored, "row").withColumn("train_tokens", F.lit(tokens).cast("long")).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_lm_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = score(documents(spark, sf_dir), crc_mod("doc_id", 5) != 1, crc_mod("doc_id", 5) == 2)
    return rows.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_lm_interpolation": op4_lm_interpolation}
