"""Resumable batches as streams: what a checkpoint has seen is not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_available(spark: SparkSession, source: str, schema: T.StructType, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> int:
    """Apply ``step`` to the files of ``source`` that are new since the last call and append the rows to ``sink``; returns the rows read.

    The rows are counted where they enter ``step``, which keeps its filters behind the count.
    """
    rows = step(spark.readStream.schema(schema).parquet(source).observe("read", F.count(F.lit(1)).alias("n")))
    query = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.observedMetrics["read"]["n"] for p in query.recentProgress if "read" in p.observedMetrics)


def append_by_key(sink: str, key: str) -> Callable[[DataFrame, int], None]:
    """A step for ``foreachBatch`` that adds a batch's rows to the table at ``sink``, each key once over all batches.

    A batch is a folder of its own, overwritten if the batch is done again after a failure, so that a restart neither loses nor repeats
    rows.  Of rows with one key in a batch the first by all columns stays; rows without key are kept as they are.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        unkeyed = batch.filter(F.col(key).isNull())
        first = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_r")).select("_r.*")
        try:
            done = spark.read.parquet(sink).filter(F.col("batch") != number).select(key)
            first = first.join(done, key, "left_anti")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        first.select(*columns).unionByName(unkeyed).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return add


def resume(spark: SparkSession, source: str, schema: T.StructType, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str, files: str = "*.parquet", files_at_once: int | None = None) -> DataFrame:
    """Bring ``sink`` up to date with the files of ``source`` and return its rows; files that the checkpoint knows are not read again."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    query = step(reader.parquet(source)).writeStream.foreachBatch(append_by_key(sink, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink).drop("batch")


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts by kind with a watermark, for streams and batches alike."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def latest_state(changes: DataFrame, key: str, order: str, status: str, final: str) -> DataFrame:
    """(key, status): a draft follows its last change until it is final, after which nothing counts."""
    first_final = F.min(F.when(F.col(status) == final, F.col(order)))
    last = F.max_by(status, order)
    return changes.groupBy(key).agg(F.when(first_final.isNotNull(), F.lit(final)).otherwise(last).alias("status"))
