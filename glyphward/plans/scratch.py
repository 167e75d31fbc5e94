"""The shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Only a local session without that setting gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/") + "/glyphward"
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="glyphward-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe from lost executors.  ``by``: a folder for each
    value of that column, so a filter on it reads no other's rows."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
