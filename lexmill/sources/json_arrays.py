"""JSON arrays as a splittable source: one file of any size is read by many tasks.

A file is cut into byte ranges. Where a range begins, a reader must know whether it is inside a string and how deep; that depends on all bytes before. So a
first job counts, for each range, its quotes and its brackets as they would be in either case; a few numbers a range are composed in order, and the second job, a
data source whose partitions are ranges with their state, finds the commas between the array's elements. An element belongs to the range that holds the
comma or bracket before it. Elements leave the source as text and are parsed by Spark, so types and bad records follow the given schema.

Files are opened in tasks by ``pyarrow.fs``: local ones and the stores it knows. Defined cases: an empty file and an empty array have no elements; an element that doesn't fit the
schema is dropped, as bad lines are; text behind the array's end is ignored; a file that doesn't begin with ``[`` isn't an array and is left to the reader of lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a range, and bytes that are looked at together.
SPLIT, BLOCK = 32 << 20, 4 << 20
QUOTE, ESCAPE, COMMA = 0x22, 0x5C, 0x2C
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1


def _open(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


def _escaped(file, at: int) -> bool:
    """Whether the byte at an offset stands behind an odd run of escapes."""
    n, step = 0, 4096
    while at - n > 0:
        begin = max(0, at - n - step)
        piece = file.read_at(at - n - begin, begin)
        kept = len(piece.rstrip(b"\\"))
        n += len(piece) - kept
        if kept:
            break
    return n % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """(mask of the quotes that open or close strings, whether the byte behind the block is escaped)."""
    slash = data == ESCAPE
    if not slash.any():
        mask = data == QUOTE
        if escaped and len(mask):
            mask[0] = False
        return mask, False
    index = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(slash, -1, index))  # the last byte that is no escape
    run = index - plain  # escapes up to and with each byte
    run[plain < 0] += int(escaped)
    before = np.concatenate(([int(escaped)], run[:-1]))
    return (data == QUOTE) & (before % 2 == 0), bool(run[-1] % 2)


def _blocks(file, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    while begin < end:
        raw = file.read_at(min(BLOCK, end - begin), begin)
        if not raw:
            return
        yield begin, raw
        begin += len(raw)


def _count(file, begin: int, end: int) -> tuple[bool, int, int]:
    """(an odd number of quotes, steps of depth if the range begins outside of a string, and if inside)."""
    escaped, odd, steps = _escaped(file, begin), False, [0, 0]
    for _, raw in _blocks(file, begin, end):
        data = np.frombuffer(raw, np.uint8)
        mask, escaped = _quotes(data, escaped)
        inside = (np.cumsum(mask, dtype=np.int32) + odd) % 2 == 1
        step = _STEP[data].astype(np.int64)
        within = int(step[inside].sum())
        steps[0] += int(step.sum()) - within
        steps[1] += within
        odd = bool((int(mask.sum()) + odd) % 2)
    return odd, steps[0], steps[1]


def _elements(file, begin: int, end: int, size: int, inside: bool, depth: int) -> Iterator[bytes]:
    """Elements whose comma or opening bracket is in [begin, end)."""
    escaped, open_, held = _escaped(file, begin), False, []
    for at, raw in _blocks(file, begin, size):
        data = np.frombuffer(raw, np.uint8)
        mask, escaped = _quotes(data, escaped)
        quoted = ((np.cumsum(mask, dtype=np.int32) + inside) % 2 == 1) | mask
        step = np.where(quoted, 0, _STEP[data]).astype(np.int64)
        deep = depth + np.cumsum(step)
        parts = (~quoted & (((data == COMMA) & (deep == 1)) | ((step == 1) & (deep == 1)) | ((step == -1) & (deep == 0))))
        start = 0
        for cut in np.flatnonzero(parts).tolist():
            if open_:
                yield b"".join([*held, raw[start:cut]])
                held, open_ = [], False
            if at + cut >= end or data[cut] == 0x5D:  # the next range's, or the array's end
                return
            open_, start = True, cut + 1
        if open_:
            held.append(raw[start:])
        elif at + len(raw) >= end:
            return
        inside, depth = bool((int(mask.sum()) + inside) % 2), int(deep[-1])


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, size: int, inside: bool, depth: int):
        self.path, self.begin, self.end, self.size, self.inside, self.depth = path, begin, end, size, inside, depth


class JsonArrayReader(DataSourceReader):
    def __init__(self, options):
        self.ranges = json.loads(options["ranges"])

    def partitions(self):
        return [Range(*r) for r in self.ranges] or [Range("", 0, 0, 0, False, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        rows, held = [], 0
        with _open(partition.path) as file:
            for element in _elements(file, partition.begin, partition.end, partition.size, partition.inside, partition.depth):
                if element.strip():
                    rows.append(element.strip().decode("utf-8", errors="replace"))
                    held += len(element)
                if held > BLOCK:
                    yield self._batch(partition.path, rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(partition.path, rows)

    @staticmethod
    def _batch(path: str, rows: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(rows)], ["file", "element"])


class JsonArraySource(DataSource):
    """``spark.read.format("json_array").option("ranges", ..)``: rows (file, element) of ranges whose state is known."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "file string, element string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return JsonArrayReader(self.options)


def ranges_of(spark: SparkSession, path: str, split: int = SPLIT) -> tuple[list[list], list[str]]:
    """(ranges [path, begin, end, size, inside, depth] of the files that are arrays, paths of the others). Files are listed by Spark without their contents; a few numbers a range come back."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with _open(r["path"]) as file:
                    head = next((raw.strip()[:1].decode("latin-1") for _, raw in _blocks(file, 0, r["size"]) if raw.strip()), "") if r["begin"] == 0 else None
                    out.append((r["path"], r["begin"], r["end"], r["size"], head, *_count(file, r["begin"], r["end"])))
            names = ["path", "begin", "end", "size", "head", "odd", "outside", "within"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long")))
    cut = files.select("path", F.col("length").alias("size"), begins.alias("begin")).withColumn("end", F.least(F.col("begin") + split, "size"))
    spread = cut.repartition(max(1, min(10_000, cut.count())))
    counted = spread.mapInArrow(count, "path string, begin long, end long, size long, head string, odd boolean, outside long, within long")
    out, other, inside, depth, skip = [], [], False, 0, False
    for r in sorted(counted.collect(), key=lambda r: (r["path"], r["begin"])):
        if r["begin"] == 0:
            inside, depth, skip = False, 0, r["head"] != "["
            if skip and r["head"]:
                other.append(r["path"])
        if not skip:
            out.append([r["path"], r["begin"], r["end"], r["size"], inside, depth])
            depth += r["within"] if inside else r["outside"]
            inside ^= r["odd"]
    return out, other


def elements(spark: SparkSession, ranges: list[list]) -> DataFrame:
    """(file, element) of the arrays' elements as text."""
    spark.dataSource.register(JsonArraySource)
    return spark.read.format("json_array").option("ranges", json.dumps(ranges)).load()


def json_arrays(spark: SparkSession, path: str, schema: StructType | str, split: int = SPLIT) -> DataFrame:
    """The records of arrays, and of files that are JSON by lines; bad ones are dropped."""
    ranges, other = ranges_of(spark, path, split)
    kind = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    parsed = elements(spark, ranges).select(F.from_json("element", schema, {"mode": "PERMISSIVE"}).alias("r")).where(F.col("r").isNotNull()).select("r.*").dropna(how="all")
    return parsed.unionByName(spark.read.schema(schema).json(other, mode="DROPMALFORMED")) if other and kind else parsed
