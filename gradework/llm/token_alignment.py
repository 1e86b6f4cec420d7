"""Operator 11: alignment of two tokenizers' tokens by the bytes that they cover.

Python only tokenizes.  A text is cut before every blank that follows another character than white space, where neither
tokenizer ever joins (no entry of B's vocabulary has its blank inside or at its end, which is asserted); so what
tokens cover is settled piece by piece, and equal pieces of neighbouring documents are aligned once.  A row of
the tokenized table is a slice of documents: the ids and byte ends of its distinct pieces, and for each
document the numbers of its pieces.

All else is Spark: ``array_intersect`` of the end arrays gives the ends where both tokenizers stop,
``transform`` and ``sequence`` build groups and links between them.  The number of
documents that hold a linked pair is counted over the corpus: shards of documents send their distinct
pairs once, and get the answers back, so that documents themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, documents, stage
from .counting import sharded
from .tokens import CACHE_ENTRIES, _BEFORE_SPACE, encoder

#: Text bytes of a slice, at most, unless one document has more.
SLICE_BYTES = 1 << 20
SHARD_DOCS = 2048
#: Up to so many shared ends a position is looked up; beyond, all are found by one sort.  Both find the same.
FEW = 64

_MARK = 1 << 31
_HIGH = 1 << 32
_TOKENIZED = "doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, codes array<array<int>>, a_ids array<array<int>>, a_ends array<array<int>>, b_ids array<array<int>>, b_ends array<array<int>>"


class Pair:
    """Both tokenizers of a worker, with the ids of the pieces that it has met."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = encoder(path_a, drops_space=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary = self.a.tokenizer.get_vocab()
        self.a_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            self.a_bytes[k] = len(token)  # a byte-level character is a byte
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_text = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        if any(not self.b.is_control(k) and " " in x.lstrip(" ") for k, x in enumerate(t.decode("utf-8", "replace") for t in self.b_text)):
            raise ValueError("an entry of tokenizer B spans a blank, so texts cannot be cut at blanks")
        self.b_bytes = np.array([len(x) for x in self.b_text], dtype=np.int64)
        self.known: dict[str, bytes | None] = {}

    def pieces(self, text: str) -> list[str]:
        """What follows the first blank of each piece of space + text."""
        if "  " in text or text[0] == " " or text[-1] == " " or "\n " in text or "\t" in text or "\r" in text:
            return [x[1:] for x in _BEFORE_SPACE.split(" " + text)]
        return text.split(" ")

    def learn(self, pieces: list[str]) -> None:
        """Ids by B of new pieces; None where B's bytes are not those of the text."""
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        for piece, ids in zip(new, self.b.encode(new, num_threads=1)):
            ids = ids or [self.b.piece_to_id("▁")]  # a last blank alone
            same = b"".join([self.b_text[i] for i in ids]) == b" " + piece.encode()
            self.known[piece] = np.array(ids, dtype="<u4").tobytes() if same else None


def _sums(parts: list[bytes], codes: np.ndarray, at: np.ndarray) -> list[int]:
    """Ids of each document, from its pieces' codes between neighbouring ``at``."""
    sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(sizes[codes])])
    return np.diff(total[at]).tolist()


def _nested(parts: list[bytes], sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """One row each: the ids of all parts as lists, and where each id's bytes end in its part."""
    ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
    at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])
    ends = (ends[1:] - np.repeat(ends[at[:-1]], np.diff(at))).astype(np.int32)
    outer = pa.array([0, len(parts)], pa.int32())
    return tuple(pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x))) for x in (ids, ends))


def tokenize(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Slices of documents (doc_id, text) with both tokenizers' ids and byte ends of their pieces."""

    pairs: list[Pair] = []

    def row(ids: list, texts: list, pair: Pair) -> pa.RecordBatch:
        if len(pair.a.known) > CACHE_ENTRIES:
            pair.a.known = type(pair.a.known)(pair.a, dict(pair.a.known))
        code: dict[str, int] = {}
        codes = [[code.setdefault(p, len(code)) for p in pair.pieces(t)] if t else [] for t in texts]
        pieces = list(code)
        pair.learn(pieces)
        by_b = [pair.known[p] for p in pieces]
        wrong = {k for k, x in enumerate(by_b) if x is None}
        by_b = [x or b"" for x in by_b]
        if wrong:
            codes = [[] if wrong.intersection(c) else c for c in codes]
        by_a = [pair.a.known[p] for p in pieces]
        a_ids, a_ends = _nested(by_a, pair.a_bytes)
        b_ids, b_ends = _nested(by_b, pair.b_bytes)
        at = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(codes), np.int32, at[-1])
        numbers = [_sums(x, flat, at) for x in (by_a, by_b)]
        outer = pa.array([0, len(codes)], pa.int32())
        of_docs = pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(pa.array(at), pa.array(flat)))
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, *numbers)]
        return pa.RecordBatch.from_arrays([*lists, of_docs, a_ids, a_ends, b_ids, b_ends], names=["doc_id", "n_a", "n_b", "codes", "a_ids", "a_ends", "b_ids", "b_ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not pairs:
            pairs.append(Pair(path_a, path_b))
        ids: list = []
        texts: list = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if texts and size + len(text or "") > SLICE_BYTES:
                    yield row(ids, texts, pairs[0])
                    ids, texts, size = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(text)
                size += len(text or "")
        if texts:
            yield row(ids, texts, pairs[0])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _TOKENIZED)


def cuts(ends: Column, shared: Column) -> Column:
    """For each of ``shared``, ascending values of the ascending array ``ends``, its place there from 1."""
    looked_up = F.transform(shared, lambda e: F.array_position(ends, e).cast("int"))
    # Sorted together, the end that a mark follows is a shared one.
    marked = F.transform(shared, lambda e: e.cast("long") * F.lit(_HIGH) + F.lit(_MARK))
    merged = F.array_sort(F.concat(F.transform(ends, lambda e, i: e.cast("long") * F.lit(_HIGH) + i), marked))
    by_sort = F.transform(
        F.array(merged),
        lambda all_: F.transform(
            F.filter(all_, lambda x, p: (x.bitwiseAND(F.lit(_MARK)) == 0) & (F.get(all_, p + 1).bitwiseAND(F.lit(_MARK)) != 0)),
            lambda x: (x.bitwiseAND(F.lit(_MARK - 1)) + 1).cast("int"),
        ),
    )[0]
    return F.when(F.size(shared) <= FEW, looked_up).when(shared.isNotNull(), by_sort)


def _begin(cut: Column, k: Column) -> Column:
    """The place from 0 at which the k-th group begins."""
    return F.when(k == 0, F.lit(0)).otherwise(F.get(cut, k - 1))


def align(tokenized: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, groups, links, n_groups) of each document of ``tokenize``'s slices.

    groups is the text of all groups, links an array of a * 2**32 + b of all linked token occurrences.
    """
    shared = tokenized.withColumn("shared", F.zip_with("a_ends", "b_ends", F.array_intersect))
    # Where all ends are shared, groups need no cuts: each is one token of either side.
    several = F.transform("shared", lambda own, p: F.when(F.get("a_ends", p) != F.get("b_ends", p), own))
    cut = shared.withColumn("shared", several).withColumns({"cut_a": F.zip_with("a_ends", "shared", cuts), "cut_b": F.zip_with("b_ends", "shared", cuts)})

    def listed(names: Column, begin: Column, end: Column) -> Column:
        several = F.array_join(F.transform(F.sequence(begin, end - 1), lambda j: F.get(names, j)), ",")
        return F.when(end - begin == 1, F.get(names, begin)).otherwise(several)

    def texts(cut_a: Column, p: Column) -> Column:
        a, b, cut_b = F.get("a_names", p), F.get("b_names", p), F.get("cut_b", p)
        one_to_one = F.zip_with(a, b, lambda x, y: F.concat(x, F.lit("|"), y))
        groups = F.transform(cut_a, lambda i, k: F.concat(listed(a, _begin(cut_a, k), i), F.lit("|"), listed(b, _begin(cut_b, k), F.get(cut_b, k))))
        return F.array_join(F.when(cut_a.isNull(), one_to_one).otherwise(groups), ";")

    def pairs(cut_a: Column, p: Column) -> Column:
        a, b, cut_b = F.get("a_ids", p), F.get("b_ids", p), F.get("cut_b", p)
        link = lambda x, y: x.cast("long") * F.lit(_HIGH) + y

        def of_group(i: Column, k: Column) -> Column:
            own_a, own_b = F.sequence(_begin(cut_a, k), i - 1), F.sequence(_begin(cut_b, k), F.get(cut_b, k) - 1)
            return F.flatten(F.transform(own_a, lambda x: F.transform(own_b, lambda y: link(F.get(a, x), F.get(b, y)))))

        groups = F.flatten(F.transform(cut_a, of_group))
        return F.when(cut_a.isNull(), F.zip_with(a, b, link)).otherwise(groups)

    named = cut.withColumns({"a_names": F.col("a_ids").cast("array<array<string>>"), "b_names": F.col("b_ids").cast("array<array<string>>")})
    built = named.withColumns({"text_of": F.transform("cut_a", texts), "links_of": F.transform("cut_a", pairs)})

    each = F.transform(
        "codes",
        lambda codes, d: F.struct(
            *(F.get(c, d).alias(c) for c in ("doc_id", "n_a", "n_b")),
            F.array_join(F.transform(codes, lambda c: F.get("text_of", c)), ";").alias("groups"),
            F.flatten(F.transform(codes, lambda c: F.get("links_of", c))).alias("links"),
        ),
    )
    # Of each group there is one bar; the sum of groups by ``aggregate`` over pieces takes a tenth of the time more.
    bars = F.length("groups") - F.length(F.replace("groups", F.lit("|"), F.lit("")))
    return built.select(F.inline(each)).withColumn("n_groups", bars.cast("long"))


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside meet where both sides lie by a part of their keys; otherwise Spark deals all links out by shard and pair."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def corpus_counts(sent: DataFrame) -> DataFrame:
    """(pair, count, best) from (shard, pair, n): in how many documents a pair is linked, and whether that is its A id's highest."""
    totals = sent.groupBy("pair").agg(F.sum("n").alias("count"))
    id_a = F.floor(F.col("pair") / F.lit(_HIGH)).cast("int")
    totals = stage(totals.withColumn("a", id_a), "alignment-counts")
    highest = totals.groupBy("a").agg(F.max("count").alias("highest"))  # at most a row for each entry of A's vocabulary
    return totals.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_corpus(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of (doc_id, text, ...).

    Null and empty texts, and those whose bytes tokenizer B does not keep, have no tokens: zeros and an empty
    groups_sha256.  Repeated rows and rows without doc_id are documents of their own; pairs with the same count are
    all the highest of their A id; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    aligned = align(tokenize(docs, path_a, path_b)).select(
        "doc_id", "n_a", "n_b", "n_groups",
        F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256"),
        F.sort_array("links").alias("links"),
    )
    held = sharded(aligned, "alignment", size=SHARD_DOCS)
    sent = stage(held.select("shard", F.explode(F.array_distinct("links")).alias("pair")).groupBy("shard", "pair").agg(F.count("*").alias("n")), "alignment-sent")
    # A shard meets its answers where it lies: the table is bucketed by shard, and so the answers are dealt.
    answers = sent.select("shard", "pair").join(corpus_counts(sent), "pair").repartition(buckets_for(spark), "shard")
    linked = held.select("shard", "row", F.explode("links").alias("pair"))
    summed = linked.join(answers.hint("shuffle_hash"), ["shard", "pair"]).groupBy("shard", "row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    with co_located(spark):
        summed = stage(summed, "alignment-sums")
    whole = held.select("shard", "row", "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups_sha256")
    nothing = F.lit(0).cast("long")
    return whole.join(summed.hint("shuffle_hash"), ["shard", "row"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", nothing).alias("n_best"), F.coalesce("count_sum", nothing).alias("count_sum"), "groups_sha256",
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of every document by the byte-level and the piece tokenizer."""
    import public_tokenizers

    return align_corpus(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
