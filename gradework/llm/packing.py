"""Operator 9: packing documents into training sequences with lexically near neighbours.

Documents are dealt over all data by their words (see ``dealing``): those with common rare words come to
lie near each other.  Shards are runs of that order, at most ``SHARD_TOKENS`` ids or ``SHARD_DOCS``
documents each, and every shard has its own BM25 inverted index.  A seed (the first
unused document of the shard) opens a sequence; the index returns its best unused neighbours, which
fill the window one after the other.  What does not fit is cut and opens the next sequence, whose seed
that document is, so every sequence holds neighbours of its own seed.  When a seed has no neighbour left
the next unused document follows, and is asked for neighbours in turn.

A sequence is filled to ``WINDOW`` ids; the rest at a shard's end goes into sequences whose lengths are
powers of two, which need no padding either.  Ids are written once and shuffled once; texts stay.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, buffers, documents, stage
from .dealing import SAMPLE_DOCS, Tree
from .tokens import encoder

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 1024
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
#: Bytes of text that are encoded at once, unless one text has more.  Distinct pieces are looked up once each time.
SLICE_BYTES = 6 << 20
#: About so many documents of each range of places are looked at to find where the ranges end.
RANGE_SAMPLE = 100
#: So many ids of a sample document count in learning how documents are dealt; all ids of all documents count in dealing.
_SAMPLE_IDS = 20_000

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bm25Index:
    """Postings of one shard, with term weights worked out beforehand."""

    def __init__(self, ids: list[np.ndarray]):
        n = len(ids)
        lengths = np.array([len(x) for x in ids], dtype=np.float64)
        pairs = np.concatenate([x.astype(np.int64) + (i << 32) for i, x in enumerate(ids)]) if n else np.zeros(0, np.int64)
        pairs, tf = np.unique(pairs, return_counts=True)
        docs, terms = pairs >> 32, pairs & 0xFFFFFFFF
        self.by_doc = np.searchsorted(docs, np.arange(n + 1))
        self.terms = terms
        df = np.bincount(terms) if len(terms) else np.zeros(1, np.int64)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n else 1.0))
        weight = idf[terms] * tf * (K1 + 1) / (tf + norm[docs])
        order = np.argsort(terms, kind="stable")
        self.list_at = np.searchsorted(terms[order], np.arange(len(df) + 1))
        self.list_docs, self.list_weight = docs[order], weight[order]
        # Long lists are added up as rows of a table, which takes less than adding them posting by posting.
        common = np.flatnonzero(df * 8 > n)
        self.row = np.full(len(df), -1)
        self.row[common] = np.arange(len(common))
        dense = self.row[terms] >= 0
        self.rows = np.zeros((len(common), n))
        self.rows[self.row[terms[dense]], docs[dense]] = weight[dense]
        self.n = n

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Unused documents by falling score over all terms of ``doc``, ties by place; those without a common term are left out."""
        terms = self.terms[self.by_doc[doc] : self.by_doc[doc + 1]]
        row = self.row[terms]
        score = self.rows[row[row >= 0]].sum(axis=0)
        rare = terms[row < 0]
        start = self.list_at[rare]
        n = self.list_at[rare + 1] - start
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        score += np.bincount(self.list_docs[at], self.list_weight[at], self.n)
        found = np.flatnonzero((score > 0) & ~used)
        return found[np.argsort(-score[found], kind="stable")]


def arrange(ids: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard."""
    index, used = Bm25Index(ids), np.zeros(len(ids), dtype=bool)
    line: list[int] = []  # the documents in the order in which they fill windows
    room = 0
    first, waiting = 0, iter(())

    while len(line) < len(ids):
        doc = next((int(x) for x in waiting if not used[x]), None) if room else None
        alone = doc is None
        if alone:
            while used[first]:
                first += 1
            doc = first
        used[doc] = True
        line.append(doc)
        opens = len(ids[doc]) > room  # it starts the next window, or what is cut off it does
        room = (room - len(ids[doc])) % window
        if alone or opens:
            waiting = iter(index.neighbours(doc, used) if room else ())
    total = sum(len(x) for x in ids)
    sizes = [window] * (total // window) + [1 << k for k in range(window.bit_length() - 1, -1, -1) if (total % window) >> k & 1]
    pieces, at, seq, offset = [], iter(sizes), -1, 0
    left = 0
    for doc in line:
        start, n = 0, len(ids[doc])
        while start < n:
            if not left:
                left, seq, offset = next(at), seq + 1, 0
            take = min(left, n - start)
            pieces.append((doc, start, take, seq, offset))
            start, left, offset = start + take, left - take, offset + take
    return pieces


def _sortable(key: tuple) -> tuple:
    """(leaf, place, salt, doc_id) with a missing doc_id first."""
    leaf, place, salt, doc_id = key
    return leaf, place, salt, doc_id is not None, doc_id or 0


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in exactly one piece; null text is the empty text, of which the end
    id alone remains; rows with the same or no doc_id are documents of their own; an empty table gives
    no rows; other columns are ignored.  ``window`` is a power of two.  sequence_id holds the partition,
    the shard and the place in it, so the rows depend on the number of partitions, but a task that runs
    again gives the same ones.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, drops_space=True, width=2).encode_array
        for batch in batches:
            upto = buffers(batch.column(1))[1]
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, max(1, int(np.searchsorted(upto, upto[at] + SLICE_BYTES, side="right")) - 1 - at))
                at += some.num_rows
                flat, offsets = encode(some.column(1), end_id)
                ids = pa.Array.from_buffers(pa.binary(), some.num_rows, [None, pa.py_buffer((2 * offsets).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), ids], names=["doc_id", "ids"])

    encoded = stage(docs.select("doc_id", "text").mapInArrow(tokenize, "doc_id long, ids binary"), "packing")
    number = encoded.count()
    parts = max(1, min(number // SHARD_DOCS, max(buckets_for(docs.sparkSession), number // (64 * SHARD_DOCS))))
    # Copies share leaf and place: the hash cuts a large group of them into several ranges.
    salted = encoded.withColumn("salt", F.xxhash64("doc_id", "ids"))
    order = ["leaf", "place", "salt", "doc_id"]

    def some(docs_due: int) -> DataFrame:
        space = 1 << 20
        return salted.filter(F.pmod("salt", F.lit(space)) < math.ceil(space * min(1.0, docs_due / max(1, number))))

    sample = some(SAMPLE_DOCS).select(F.substring("ids", 1, 2 * _SAMPLE_IDS).alias("ids"))
    tree = docs.sparkSession.sparkContext.broadcast(Tree([np.frombuffer(r["ids"], "<u2") for r in sample.collect()]))

    def dealt(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
        """``rows`` with leaf, place and the range in which they lie, by the ranges' ends."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, place = tree.value.places([np.frombuffer(x, "<u2") for x in batch.column(1).to_pylist()])
                keys = zip(leaf.tolist(), place.tolist(), batch.column(2).to_pylist(), batch.column(0).to_pylist())
                part = [bisect_right(bounds, _sortable(k)) for k in keys]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(place), pa.array(part, pa.int32())], names=["doc_id", "ids", "salt", "leaf", "place", "part"])

        return rows.mapInArrow(deal, "doc_id long, ids binary, salt long, leaf long, place double, part int")

    # As Spark's own ranges are found, but without dealing all documents for it.
    ends = sorted(_sortable(r) for r in dealt(some(RANGE_SAMPLE * parts), []).select(*order).collect()) if parts > 1 else []
    bounds = [ends[k * len(ends) // parts] for k in range(1, parts)] if ends else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        shard, keys, ids, held = 0, [], [], 0

        def close() -> pa.RecordBatch:
            doc, start, length, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*arrange(ids, window)))
            crc = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n in zip(doc, start, length)]
            counts = np.array([len(x) for x in ids], dtype=np.int64)
            key = pa.array(keys, pa.int64()).take(pa.array(doc))
            sequence = (part << 40) + (shard << 24) + seq
            return pa.RecordBatch.from_arrays(
                [key, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[doc]), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = np.frombuffer(raw, "<u2").astype(np.uint32)
                keys.append(key)
                ids.append(tokens)
                held += len(tokens)
                if len(ids) >= SHARD_DOCS or held >= SHARD_TOKENS:
                    yield close()
                    shard, keys, ids, held = shard + 1, [], [], 0
        if ids:
            yield close()

    ranges = dealt(salted, bounds).repartitionById(parts, "part").sortWithinPartitions(*order)
    return ranges.select("doc_id", "ids").mapInArrow(run, _SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document of ``documents``."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_packing": op9_packing}
