"""Parquet sinks, ad-hoc SQL and the versioned result table."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local_roots: dict[str, str] = {}
_stages: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset a single-machine session gets one of its own; a cluster is an error,
    as its executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            atexit.register(shutil.rmtree, _local_roots[app], True)
        root = _local_roots[app]
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def write_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write once: an existing path is an error, never overwritten."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write a stage once to the shared folder and read it back.

    For an intermediate panel that several branches read: it is computed once, its lineage ends
    here, and the loss of an executor costs nothing that was written.
    """
    path = shared_folder(df.sparkSession)
    _stages.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stages(spark: SparkSession) -> list[str]:
    """Folders that ``materialise`` has written in this application and that are not released."""
    return list(_stages.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete stages that no frame still to be computed reads."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    kept = _stages.get(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in kept:
            kept.remove(p)


def run_sql(spark: SparkSession, path: str, view: str, text: str) -> DataFrame:
    """Read-only SQL over one Parquet path, seen as ``view``."""
    spark.read.parquet(path).createOrReplaceTempView(view)
    return spark.sql(text)


def append_results(df: DataFrame, path: str, run_id: str) -> None:
    """Append one run's results; earlier runs stay and are stood down by ``current_results``."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def current_results(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key: a map-side combining max, no sort of the history."""
    rest = [c for c in history.columns if c not in keys]
    return (
        history.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"),
            F.count(F.lit(1)).alias("versions"),
        )
        .select(*keys, "_row.*", "versions")
    )
