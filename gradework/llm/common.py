"""Helpers shared by the training-data operators: shared storage, text hashing, document loading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; a folder of our own is set only where
    that is unset on one machine, as in tests.  On a cluster the setting is required.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(context, "_gradework_shared", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="gradework-")
            context._gradework_shared = folder
            context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and losing an executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete what ``stage`` wrote and gave back as ``staged``; nothing may read it any more."""
    spark = staged.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, name: str, column: str) -> tuple[DataFrame, DataFrame]:
    """``df`` written once and read in two ways: as a table whose rows lie by ``column``, which joins by it do not move, and as files.

    ``df`` should be dealt by ``column`` already, into ``buckets_for`` partitions; then each writes one file.
    """
    spark = df.sparkSession
    table, path = f"{name}_{uuid.uuid4().hex}", new_path(spark, name)
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets_for(spark), column).saveAsTable(table)
    return spark.table(table), spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run inside go when the query ends, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def buckets_for(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------------------------------------
# Words as 64-bit numbers.  A word's hash is a polynomial in its bytes modulo 2**64, read off prefix
# sums of the whole buffer, so that no Python object is made for any word.

_SLICE = 1 << 20


def _random_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _random_table(11)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, _SLICE + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near values spread over all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _slice_hashes(data: np.ndarray, offsets: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    black = ~_SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = black[:-1]
    at = offsets[:-1]
    before[at[at < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = black[1:]
    ends_at = offsets[1:]
    after[ends_at[(ends_at > 0)] - 1] = False
    starts = np.flatnonzero(black & ~before)
    ends = np.flatnonzero(black & ~after) + 1
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(byte_ids[data] * _powers(_BASE, n)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts])
    return hashes, np.searchsorted(starts, offsets), starts, ends


def word_hashes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lower-cased, and each text's offsets in them."""
    data, offsets = buffers(texts)
    hashes, counts = [], [np.zeros(1, np.int64)]
    i, last, base = 0, len(offsets) - 1, 0
    while i < last:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, side="right")) - 1)
        part, words, _, _ = _slice_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _BYTE)
        hashes.append(part)
        counts.append(words[1:] + base)
        base += len(part)
        i = j
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(counts)


def prefix_sums(items: np.ndarray) -> np.ndarray:
    """Sums before each place of ``items`` times powers of a base, of which ``stretch_hashes`` reads any stretch."""
    sums = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(items * _powers(_BASE, len(items))[: len(items)], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each stretch of items, by value and place within the stretch."""
    return (sums[ends] - sums[starts]) * _powers(_INVERSE, len(sums))[starts]


def polynomials(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash for each stretch of ``hashes`` between neighbouring offsets, by value and place of its items."""
    return stretch_hashes(prefix_sums(hashes), offsets[:-1], offsets[1:])


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring items."""
    out = hashes[: max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
    return out
