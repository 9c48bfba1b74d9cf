"""Results that later steps use more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one on this machine if all tasks run on it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return (found if "://" in found or found.startswith("file:") else f"file://{found}").rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder: what uses them reads them, whatever executors are lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written once as a table in the shared folder: its size is known to what reads it, and columns not asked for aren't read."""
    path = f"{shared_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
