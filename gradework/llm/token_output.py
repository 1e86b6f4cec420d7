"""Operator 1: token ids as binary Parquet, for selective reads of tokens and of metadata.

Layout: one row per document in ascending ``doc_id`` order over files and inside each; ``tokens`` is a
list of integers, dictionary encoded; ``doc_id`` and ``n_tokens`` are delta encoded (Parquet format 2
pages).  Row groups and pages are small and of a fixed size, and Parquet's column and offset indexes
are written, so a reader that wants one document, or metadata alone, reads a few pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, documents, new_path
from .tokens import encoder

ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10
END_ID = 2
#: Text bytes that are encoded at once, unless one document has more; pieces are told apart once a slice.
SLICE_BYTES = 6 << 20

_SCHEMA = "doc_id long, n_tokens long, tokens array<int>"


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, tokens) of each document; null is the empty text, ``end_id`` closes each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, drops_space=False).encode_array
        for batch in batches:
            ends, at = buffers(batch.column(1))[1], 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
                part, at = batch.slice(at, stop - at), stop
                ids, offsets = encode(part.column(1), end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), lists],
                    names=["doc_id", "n_tokens", "tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Write the token files of ``docs`` to ``path``.

    Equal ``doc_id`` rows stay apart, in an order of their texts; an empty table gives no rows; other
    columns of ``docs`` are ignored.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        encode_documents(ordered, tokenizer_path, end_id)
        .withColumn("shard", F.spark_partition_id())
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.writer.version", "PARQUET_2_0")
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, n_tokens) of the token files; the token pages are not read."""
    return spark.read.schema("shard int, doc_id long, n_tokens long").parquet(path)


def with_start(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """``rows`` (shard, doc_id, n_tokens, ...) with ``start``, the number of ids before the document.

    It is the total of the files before plus a running sum inside the file's rows, so no task holds more
    than one file's metadata.
    """
    totals = metadata.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard").orderBy("doc_id", "_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "shard")
        .withColumn("start", F.col("_base") + F.col("_inside"))
        .drop("_at", "_base", "_inside")
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(shard, doc_id, n_tokens, tokens), of some documents only if asked; the ids are pushed to the page indexes."""
    rows = spark.read.schema(f"shard int, {_SCHEMA}").parquet(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def checksums(tokens: DataFrame) -> DataFrame:
    """(shard, doc_id, n_tokens, ids_crc32) from the token lists, as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            offsets = ids.offsets.to_numpy()
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            view = memoryview(values).cast("B") if len(values) else memoryview(b"")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "n_tokens", "ids_crc32"],
            )

    return tokens.select("shard", "doc_id", "tokens").mapInArrow(run, "shard int, doc_id long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = with_start(checksums(read_tokens(spark, path)), read_metadata(spark, path))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op1_token_output": op1_token_output}
