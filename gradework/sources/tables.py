"""Sources and sinks: explicit schemas, no inference, appends that refuse another header."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of labels and of splits.
LABELS = T.StructType([T.StructField("id_code", T.StringType()), T.StructField("diagnosis", T.IntegerType())])
SPLITS = T.StructType([T.StructField(c, T.StringType()) for c in ("id_code", "split", "cv_fold", "sample_source", "grade", "resolution")])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: bool = False) -> DataFrame:
    """A headed CSV by an explicit schema; ids such as 1e3 stay text.  With ``required`` an empty table is an error."""
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False)
    if required and df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id_code): one id a line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id_code")).filter("id_code <> ''")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(id_code, path, content) of image files; the name without its ending is the id."""
    name = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("id_code"), "path", "content", F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Named columns only, in their order; null is the empty field."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_candidates(df: DataFrame, path: str) -> None:
    """Candidates by lesion class, so that a class is read alone."""
    df.write.mode("overwrite").partitionBy("lesion").parquet(path)


def append_pending(work: DataFrame, path: str, key: str) -> DataFrame:
    """Append those rows of ``work`` whose key is not in ``path`` yet; a table of other columns is refused.  Returns what was pending."""
    spark = work.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  nothing is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        work.write.parquet(path)
        return work
    if done.columns != work.columns:
        raise ValueError(f"columns of {path} are {done.columns}, not {work.columns}")
    rows = work.join(done.select(key), key, "left_anti").select(*work.columns)
    rows.write.mode("append").parquet(path)
    return rows


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that the driver and all executors reach: below ``spark.checkpoint.dir``, or a folder of this machine on a local master alone."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(context, "_gradework_scratch", None) or "file://" + tempfile.mkdtemp(prefix="gradework-")
        context._gradework_scratch = folder
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table, oldest first: those whose write left its mark of success."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(re.search(r"version=(\d+)/", f.getPath().toString())[1]) for f in (found or []))


def write_version(df: DataFrame, path: str) -> int:
    """Write ``df`` as the next version of the table at ``path``; earlier versions stay, and are what is read until this one is complete.

    A version that an earlier, failed write left is overwritten.  One writer at a time is assumed.
    """
    spark = df.sparkSession
    number = max(versions(spark, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table's latest complete version, or a given one."""
    known = versions(spark, path)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"{path} has no complete version" + (f" {number}" if number is not None else ""))
    return spark.read.parquet(f"{path}/version={number or known[-1]}")


def save_bundle(spark: SparkSession, path: str, models: dict, settings: dict) -> int:
    """Save fitted Spark ML models and a dictionary of settings as one version; settings are written last and complete it."""
    number = max(versions(spark, path), default=0) + 1
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/version={number}-models/{name}")
    kinds = {name: f"{type(m).__module__}.{type(m).__name__}" for name, m in models.items()}
    row = [(json.dumps({"settings": settings, "models": kinds}),)]
    spark.createDataFrame(row, "bundle string").write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def load_bundle(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """(models, settings) of the latest complete bundle."""
    import importlib

    known = versions(spark, path)
    bundle = json.loads(read_version(spark, path).first()["bundle"])
    models = {}
    for name, kind in bundle["models"].items():
        module, _, cls = kind.rpartition(".")
        if not module.startswith("pyspark.ml"):
            raise ValueError(f"{kind} is no Spark ML model")
        models[name] = getattr(importlib.import_module(module), cls).load(f"{path}/version={known[-1]}-models/{name}")
    return models, bundle["settings"]
