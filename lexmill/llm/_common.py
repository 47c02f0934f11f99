"""Shared helpers: scratch tables in the cluster's shared folder, size-checked broadcasts, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import math
import posixpath
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table is broadcast only up to this many bytes, as measured before the join.
BROADCAST_BYTES = 64 << 20
#: Spark's setting that deletes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir or of the context's checkpoint directory; in local mode, a folder of our
    own where neither is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for what is executed inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def shuffle_freed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of what is executed inside go when it has ended."""
    return setting(spark, CLEANUP, "true")


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    with shuffle_freed(spark):
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.parquet(path)


def release() -> None:
    """Give freed memory back, so that a Python worker doesn't keep the peak of what it has done."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def forget(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more: whatever came of them must be saved itself."""
    for df in tables:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def bounded(df: DataFrame, row_bytes: int = 64, limit: int = BROADCAST_BYTES, more: Column | None = None) -> DataFrame:
    """Mark an already saved table for broadcast if its counted size is under the limit; else leave it to a shuffled join. ``more`` is what a row takes beside ``row_bytes``, where rows
    aren't of one size."""
    size = F.count("*") * row_bytes if more is None else F.count("*") * row_bytes + F.coalesce(F.sum(more.cast("long")), F.lit(0))
    return F.broadcast(df) if df.agg(size).first()[0] <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; sizes partitions and buckets."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(digest, rep, text) of each distinct text once, null as empty; rep is its smallest doc_id, null only if it has no other."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    rows = keyed.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("least")
    groups = rows.groupBy("digest").agg(least, F.sum("n").alias("copies")).where("copies > 1")
    more = saved(groups.select(F.col("digest").alias("d"), F.col("least.doc_id").alias("rep"), (F.col("least.n") > 1).alias("again")), "texts")
    one = keyed.join(bounded(more, 80), F.col("digest") == F.col("d"), "left").where("d is null or doc_id <=> rep").select("digest", F.col("doc_id").alias("rep"), "text", "again")
    if not more.where("again").take(1):
        return one.select("digest", "rep", "text")
    again = one.where("again").groupBy("digest").agg(F.first("rep").alias("rep"), F.first("text").alias("text"))  # rows with one doc_id and text
    return one.where("again is null or not again").select("digest", "rep", "text").unionByName(again)


def kept_rows(docs: DataFrame, ids: DataFrame, there: bool = True) -> DataFrame:
    """The rows of ``docs``, unchanged, whose doc_id is among the distinct ``ids`` (doc_id; null is one too), or isn't."""
    name = f"id_{uuid.uuid4().hex}"  # no column of docs has it
    some = bounded(saved(ids.select(F.col("doc_id").alias(name)), "ids"), 16)
    return docs.join(some, docs["doc_id"].eqNullSafe(some[name]), "left_semi" if there else "left_anti")
