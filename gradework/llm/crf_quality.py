"""Operator 3: document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its features are its own shape (shares of character classes, lengths, repeated
words) and that of the lines before and after it.  Training lines take their document's label.  The
marginal probabilities of forward-backward, weighted by the lines' lengths, give a document's score.

Bound: the field is learned from at most ``MAX_TRAIN_DOCS`` labelled documents, chosen by hash, of which
those are used, in hash order, that fit ``MAX_TRAIN_LINES`` lines.  Every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, _slice_hashes, buffers, crc_mod, documents

MAX_TRAIN_DOCS = 3000
MAX_TRAIN_LINES = 60_000
ITERATIONS = 120
RATE, PENALTY = 0.1, 1e-3

_SLICE = 1 << 20
_CLASSES = ("lower", "upper", "digit", "space", "stop", "shout", "bar", "sign", "beyond ASCII")
_CLASS = np.full(256, 7, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[ord("|")] = 6
_CLASS[128:] = 8
_OWN = len(_CLASSES) + 4
FEATURES = 1 + 3 * _OWN + 2


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths, and each text's offsets in them.  A text without a break is one line."""
    data, offsets = buffers(texts)
    features, lengths, counts = [], [], []
    i, last = 0, len(offsets) - 1
    while i < last:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, side="right")) - 1)
        f, n, c = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        features.append(f)
        lengths.append(n)
        counts.append(c)
        i = j
    if not features:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0), np.zeros(1, np.int64)
    return np.concatenate(features), np.concatenate(lengths), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(data == 10)
    of_text = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((np.concatenate([np.zeros(len(offsets) - 1), np.ones(len(breaks))]), starts, np.concatenate([np.arange(len(offsets) - 1), of_text])))
    starts, text = starts[order], np.concatenate([np.arange(len(offsets) - 1), of_text])[order]
    counts = np.bincount(text, minlength=len(offsets) - 1)
    n = len(starts)
    ends = np.append(starts[1:], len(data))
    final = np.append(text[1:] != text[:-1], True)
    ends = np.where(final, offsets[1:][text], ends - 1)  # without the break
    lengths = (ends - starts).astype(np.float64)
    line = np.repeat(np.arange(n), np.where(final, ends - starts, ends - starts + 1))
    shape = np.bincount(line * len(_CLASSES) + _CLASS[data], minlength=n * len(_CLASSES)).reshape(n, -1).astype(np.float64)
    shape[:, 3] -= ~final  # the break itself
    shape /= np.maximum(lengths, 1)[:, None]
    hashes, _, word_at, _ = _slice_hashes(data, offsets, _BYTE)
    word_line = line[word_at]
    words = np.bincount(word_line, minlength=n)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_line[1:] == word_line[:-1])
    repeated = np.bincount(word_line, again, n) / np.maximum(words, 1)
    own = np.column_stack([shape, np.log1p(lengths) / 8, np.log1p(words) / 6, np.minimum(lengths / np.maximum(words, 1), 30) / 10, repeated])
    before, after = np.zeros_like(own), np.zeros_like(own)
    first = np.append(True, final[:-1])
    before[1:] = own[:-1]
    before[first] = 0
    after[:-1] = own[1:]
    after[final] = 0
    return np.column_stack([np.ones(n), own, before, after, first, final]).astype(np.float32), np.maximum(lengths, 1), counts


def marginals(unary: np.ndarray, at: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, the expected moves (from, to) summed over all texts, and each text's log partition.

    unary is the log potential of good against bad, move the 2 x 2 log potentials; texts advance together.
    """
    counts = np.diff(at)
    order = np.argsort(-counts, kind="stable")
    longest = int(counts.max()) if len(counts) else 0
    active = np.searchsorted(-counts[order], -np.arange(1, longest + 1), side="right")
    forward, backward = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    for t in range(longest):
        own = at[order[: active[t]]] + t
        score = np.zeros((len(own), 2)) if t == 0 else np.logaddexp(forward[own - 1, :1] + move[0], forward[own - 1, 1:] + move[1])
        score[:, 1] += unary[own]
        forward[own] = score
    for t in range(longest - 2, -1, -1):
        own = at[order[: active[t + 1]]] + t
        ahead = backward[own + 1].copy()
        ahead[:, 1] += unary[own + 1]
        backward[own] = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
    ends = at[1:] - 1
    total = np.logaddexp(forward[ends, 0], forward[ends, 1])
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    inner = np.ones(len(unary), dtype=bool)
    inner[at[:-1]] = False
    to = np.flatnonzero(inner)
    of = np.repeat(np.arange(len(counts)), counts)[to]
    ahead = backward[to].copy()
    ahead[:, 1] += unary[to]
    pair = forward[to - 1][:, :, None] + move[None] + ahead[:, None, :] - total[of][:, None, None]
    return good, np.exp(np.minimum(pair, 0)).sum(axis=0), total


def fit(features: np.ndarray, at: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of the field by penalised likelihood (Adam, all rows a step)."""
    mean, spread = features.mean(axis=0), features.std(axis=0)
    mean[0], spread[0] = 0, 1
    spread[spread < 1e-6] = 1
    x = ((features - mean) / spread).astype(np.float64)
    counts = np.diff(at)
    line_labels = np.repeat(labels, counts)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (counts[labels == label] - 1).sum()
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ITERATIONS + 1):
        good, moves, _ = marginals(x @ theta[:-4], at, theta[-4:].reshape(2, 2))
        slope = np.concatenate([x.T @ (line_labels - good), (seen - moves).ravel()]) / max(1, len(x)) - PENALTY * theta
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"mean": mean, "spread": spread, "weights": theta[:-4], "move": theta[-4:].reshape(2, 2)}


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_lines: int = MAX_TRAIN_LINES) -> dict[str, np.ndarray] | None:
    """The field from documents (doc_id, text) and labels (doc_id, quality); None without labels of both kinds."""
    known = labels.filter(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("order"))
    n = known.count()
    space = 1 << 20
    share = min(space, int(space * max_docs / max(n, 1)) + 1)
    sample = known.filter(F.pmod(F.col("order"), F.lit(space)) < share).orderBy("order", "quality").limit(max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, _, at = line_features(batch.column(2))
            raw = [features[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["order", "quality", "features"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("order", "quality", "text").mapInArrow(run, "order long, quality int, features binary").collect()
    taken, lines = [], 0
    for r in sorted(rows, key=lambda r: (r["order"], r["quality"], bytes(r["features"]))):
        own = len(r["features"]) // (4 * FEATURES)
        if lines + own <= max_lines:
            taken.append(r)
            lines += own
    y = np.array([r["quality"] for r in taken], dtype=np.int64)
    if len(np.unique(y)) < 2:
        return None
    matrices = [np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in taken]
    at = np.concatenate([[0], np.cumsum([len(x) for x in matrices])])
    return fit(np.concatenate(matrices), at, y)


def assess(docs: DataFrame, field: dict[str, np.ndarray] | None) -> DataFrame:
    """(doc_id, held-back columns, score, n_lines) of every document of (doc_id, text, ...), in its own row.

    Null and empty texts are one empty line; repeated rows and rows without doc_id are documents of their
    own; an empty table gives no rows; without a field every score is 0.5.  Only text is read for a score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                features, lengths, at = line_features(part.column(1))
                if field is None:
                    good = np.full(len(lengths), 0.5)
                else:
                    good, _, _ = marginals(((features - field["mean"]) / field["spread"]) @ field["weights"], at, field["move"])
                total = np.add.reduceat(lengths, at[:-1]) if part.num_rows else np.zeros(0)
                score = np.add.reduceat(good * lengths, at[:-1]) / total if part.num_rows else total
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(score, 0, 1)), pa.array(np.diff(at).astype(np.int64))], names=["doc_id", "score", "n_lines"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_lines long")


def op3_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out rows are never read for learning."""
    docs = documents(spark, sf_dir)
    held_out: Column = crc_mod("doc_id", 3) == 1
    field = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out))
    rows = assess(docs, field)
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op3_crf_quality": op3_crf_quality}
