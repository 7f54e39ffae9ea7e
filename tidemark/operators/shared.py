"""Tables in the folder that driver and executors share, which are deleted when the driver ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a session in one process that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local_roots.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What is written there goes when the driver ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table: what reads it twice computes it once, and a lost executor costs no more than its tasks."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
