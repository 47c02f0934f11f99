"""Token ids as Parquet: list columns in range-partitioned, sorted files with small pages and page indexes.

Rows are range-partitioned and sorted by doc_id before they are encoded, so each text is shuffled and encoded once. A
row carries its partition's number and the count of ids before it in that partition; the start of a partition is the sum
of the totals before it, one number for each file. ids are dictionary-encoded, the other columns delta-encoded (format
version 2); Spark's writer commits files, and writes column and offset indexes, so that a reader can take doc_id and
counts without the ids, or the pages of a doc_id range only.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first; rows with one doc_id follow each
other by text; repeated rows are encoded each; an empty table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, parts, release, scratch, setting, shuffle_freed, text_bytes
from ._encode import encoder, expand, pieces_of

#: Texts that go to a Python worker at once, in both directions, and bytes of them that are encoded at once.
ROWS, SLICE = 2000, 6 << 20
SCHEMA = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"
#: Row groups of 32 MB, pages of 128 kB, dictionaries for ids only, delta for the rest.
LAYOUT = {
    "compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size": str(128 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false", "parquet.enable.dictionary#n_tokens": "false",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, special_as_text: bool = False, part_bytes: int = 16 << 20) -> None:
    """Encode each text, append ``end_id``, and write files in ascending doc_id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part, at = encoder(tokenizer, False, special_as_text), TaskContext.get().partitionId(), 0
        for k, batch in enumerate(x for b in batches for x in pieces_of(b, "text", SLICE)):
            n, ids, _ = made.encode(batch.column("text"))
            out = np.full(len(ids) + len(n), end_id, np.int32)
            first = np.cumsum(n) - n
            out[expand(first + np.arange(len(n)), n)] = ids
            n = n + 1
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), pa.array(at + ends - n), pa.array(n), lists],
                ["part", "doc_id", "local_start", "n_tokens", "ids"],
            )
            at += int(ends[-1]) if len(n) else 0
            if k % 2:
                release()

    key = F.col("doc_id").asc_nulls_first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts(text_bytes(docs), part_bytes), key)
    with shuffle_freed(docs.sparkSession), setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS)):
        rows.sortWithinPartitions(key, "text").mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """(part, base): ids before each partition. Reads counts only; one row for each file of ``part_bytes`` or more."""
    totals = files.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def read_tokens(files: DataFrame) -> DataFrame:
    """Per row of the files: doc_id, start, n_tokens and ids_crc32, all from what was read."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            raw = memoryview(values).cast("B")
            sums = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.int64, len(lists))
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), batch.column("local_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums)],
                ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )

    rows = files.mapInArrow(check, "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(bounded(starts(files), 24), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def id_range(files: DataFrame, first: int, last: int) -> DataFrame:
    """doc_id and ids of first <= doc_id <= last. The filter reaches the scan, where column indexes leave only the pages of that range to
    be read; a select of other columns leaves out the ids."""
    return files.where(F.col("doc_id").between(first, last)).select("doc_id", "n_tokens", "ids")


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession.read.schema(SCHEMA).parquet(path))
