"""Counts over the corpus for keys that are gathered shard by shard.

Documents are dealt into shards, kept in a bucketed table, so that later steps meet a shard's texts again
without a shuffle.  A shard sends its distinct keys, sorted and packed, to the ranges of the key space;
a range adds up and answers each shard in the order of its keys.  Only packed keys and counts move.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, new_path

SHARD_ROWS = 1024

#: What goes between shards and ranges; ``keys`` and the counts are packed arrays.
MESSAGE = "shard long, range long, kind int, keys binary, counts binary, row long"


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array of unsigned integers, byte plane by byte plane."""
    import zstandard

    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def bounds(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where the ranges' parts of sorted keys of ``bits`` bits begin and end."""
    edges = np.array([(k << bits) // ranges for k in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def sharded(rows: DataFrame, name: str, apart: str | None = None, size: int = SHARD_ROWS) -> DataFrame:
    """``rows`` with row and shard, in a table bucketed by shard.

    A shard is ``size`` neighbouring rows of an input partition, so writing moves nothing.  Rows for
    which the boolean column ``apart`` holds have shards of their own, with odd numbers.
    """
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    at = F.monotonically_increasing_id()
    odd = F.col(apart).cast("long") if apart else F.lit(0)
    numbered = rows.withColumn("row", at).withColumn("shard", F.floor(F.col("row") / size) * 2 + odd)
    writer = numbered.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, name))
    writer.bucketBy(buckets_for(spark), "shard").saveAsTable(table)
    return spark.table(table)


def messages(shard: int, kind: int, keys: np.ndarray, counts: list[np.ndarray], ranges: int, bits: int) -> Iterator[tuple]:
    """A shard's sorted distinct keys with one or more counts each, a message for each range."""
    at = bounds(keys, ranges, bits)
    for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b > a:
            yield shard, k, kind, pack_sorted(keys[a:b]), b"".join(len(p).to_bytes(4, "little") + p for p in (pack(c[a:b].astype(np.uint64)) for c in counts)), -1


def count_list(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(unpack(raw[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


_FIELDS = [("shard", pa.int64()), ("range", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("row", pa.int64())]


def message_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(_FIELDS, columns)})


def add_up(sent: DataFrame) -> DataFrame:
    """The answers to the shards' messages: the counts of each key over all shards.

    An answer has the counts alone, in the order in which the shard sent the keys.  A last message to
    shard -1 of each range and kind has, in its counts, for each count the sum, the number of keys above
    zero and the sum of squares of the range.
    """

    def run(table: pa.Table) -> pa.Table:
        kind, place = int(table["kind"][0].as_py()), int(table["range"][0].as_py())
        shards = table["shard"].to_pylist()
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        counts = [count_list(x) for x in table["counts"].to_pylist()]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = [np.bincount(inverse, np.concatenate([c[i] for c in counts]).astype(np.float64), len(distinct)).astype(np.uint64) for i in range(len(counts[0]))]
        out, at = [], 0
        for shard, own in zip(shards, keys):
            which = inverse[at : at + len(own)]
            at += len(own)
            out.append((shard, place, kind, b"", b"".join(len(p).to_bytes(4, "little") + p for p in (pack(t[which]) for t in totals)), -1))
        stats = [int(f(t)) for t in totals for f in (np.sum, np.count_nonzero, lambda t: (t.astype(np.float64) ** 2).sum())]
        out.append((-1, place, kind, b"", np.array(stats, dtype="<i8").tobytes(), -1))
        return message_table(out)

    return sent.groupBy("kind", "range").applyInArrow(run, MESSAGE)


def statistics(answers: DataFrame) -> dict[int, np.ndarray]:
    """kind -> the sums over all ranges of the statistics that ``add_up`` leaves; a row for each range."""
    out: dict[int, np.ndarray] = {}
    for r in answers.filter("shard = -1").select("kind", "counts").collect():
        own = np.frombuffer(r["counts"], "<i8")
        out[r["kind"]] = out.get(r["kind"], 0) + own
    return out
