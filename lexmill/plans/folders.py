"""Folders for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(s: SparkSession) -> str:
    """A new folder in the cluster's shared one; in local mode a temporary one where none is set."""
    base = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    if not base:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='laws-')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage: write and read back, so that a lost executor costs no earlier step."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)
