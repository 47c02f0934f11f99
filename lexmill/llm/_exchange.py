"""Ask all chunks about fingerprints and get each chunk its answers.

Documents are staged in chunks of bounded size, a row each (compressed bytes), so a pass over them costs no row
handling in the JVM and a chunk is always seen whole. In an exchange (operator 1 only) each chunk sends its distinct keys and
values, cut into buckets; each bucket gathers the keys of all chunks, settles them (a sum, a minimum, ...)
and answers in the same order; the answers are a table partitioned by chunk in the shared folder, where the next pass
over a chunk reads its own. Buckets are ranges of hashes, and a chunk sends a key once, so they are even whatever a key's
frequency; no table of all keys is ever in one place.

The shared folder must be one that pyarrow.fs can open (file, hdfs, s3, gs).
"""

from __future__ import annotations

import ctypes
import posixpath
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import parts, release, scratch, shuffle_freed
from ._words import M1, M2, M3, distinct, mix  # noqa: F401

CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
Arrays = dict[str, np.ndarray]


#: Ascending columns are packed as differences.
ASCENDING = ("key", "ctx", "id")


def pack(arrays: Arrays) -> bytes:
    """Columns of one length: a line that names them, then their bytes by place (all first bytes, all second bytes, ..), compressed."""
    head, planes = [], []
    for name, a in arrays.items():
        if name in ASCENDING:
            a = np.diff(a, prepend=a.dtype.type(0))
        planes.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
        head.append(f"{name}:{a.dtype.str}")
    return f"{len(a)},{','.join(head)}\n".encode() + pa.Codec("zstd", compression_level=1).compress(b"".join(planes), asbytes=True)


def unpack(data: pa.Buffer | bytes) -> Arrays:
    data = bytes(data)
    end = data.index(b"\n")
    n, *columns = data[:end].decode().split(",")
    n, kinds = int(n), {c.split(":")[0]: np.dtype(c.split(":")[1]) for c in columns}
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[end + 1 :], n * sum(t.itemsize for t in kinds.values()), asbytes=True), np.uint8)
    out, at = {}, 0
    for name, t in kinds.items():
        a = np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).reshape(-1).view(t)
        out[name] = np.cumsum(a, dtype=t) if name in ASCENDING else a
        at += n * t.itemsize
    return out


def chunked(docs: DataFrame, label: str, form: Callable[[pa.Table], dict[str, bytes]], columns: Sequence[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, *columns): what ``form`` makes of the rows of ``docs``, which has a column ``text``, in chunks of about ``chunk_bytes`` of text."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row(held: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
            made = form(pa.Table.from_batches(held).combine_chunks())
            release()
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + k], pa.int64()), *[pa.array([made[c]], pa.binary()) for c in columns]], ["chunk", *columns])

        for batch in batches:
            text = batch.column("text")
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            at = 0
            while at < len(batch):
                take = max(1, int(np.searchsorted(ends, ends[at] + chunk_bytes - size)) - at)
                take = min(take, len(batch) - at)
                held.append(batch.slice(at, take))
                size += int(ends[at + take] - ends[at])
                at += take
                if size >= chunk_bytes * 0.9:
                    yield row(held, made)
                    made, held, size = made + 1, [], 0
        if held:
            yield row(held, made)

    path = scratch(docs.sparkSession, f"{label}-chunks")
    schema = ", ".join(("chunk bigint", *(f"{c} binary" for c in columns)))
    docs.mapInArrow(stage, schema).write.options(**{"compression": "none", "parquet.block.size": str(16 << 20)}).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def keep_memory() -> None:
    """Arrays that are freed inside a pass stay with the process for the next ones; ``release`` gives them back at a chunk's end."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, 512 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def open_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, pa.Buffer]]]:
    keep_memory()
    for batch in batches:
        for i, chunk in enumerate(batch.column("chunk").to_pylist()):
            yield chunk, {c: batch.column(c)[i].as_buffer() for c in batch.schema.names if c != "chunk"}
            release()


class Answers(NamedTuple):
    """What an exchange has answered: the folder of each round, and buckets of a kind of keys."""

    paths: tuple[str, ...]
    buckets: int


def answers(found: Answers, chunk: int, kind: int = 0) -> Arrays:
    """What an exchange has answered to a chunk for a kind of keys, in the order of its keys, and the ``bucket`` of each."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    got = []
    for path in found.paths:
        store, folder = fs.FileSystem.from_uri(path)
        files = store.get_file_info(fs.FileSelector(posixpath.join(folder, f"chunk={chunk}"), allow_not_found=True))
        got += [pq.read_table(f.path, filesystem=store, partitioning=None, columns=["bucket", "payload"]) for f in files if f.path.endswith(".parquet")]
    if not got:
        return {}
    table = pa.concat_tables(got).sort_by("bucket")
    bucket = table.column("bucket").to_numpy()
    a, b = np.searchsorted(bucket, (kind * found.buckets, (kind + 1) * found.buckets)).tolist()
    each = [unpack(x.as_buffer()) for x in table.column("payload").slice(a, b - a)]
    for x, own in zip(each, bucket[a:b].tolist(), strict=True):
        x["bucket"] = np.full(len(next(iter(x.values()))), own - kind * found.buckets, np.uint64)
    return {k: np.concatenate([x[k] for x in each]) for k in each[0]} if each else {}


def buckets_for(total_bytes: int, each: int = BUCKET_BYTES) -> int:
    return parts(total_bytes, each, 8)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By key range: ascending with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def exchange(
    chunks: DataFrame,
    label: str,
    emit: Callable[[int, dict[str, pa.Buffer]], Sequence[tuple[np.ndarray, Arrays]]],
    settle: Sequence[Callable[[Arrays], tuple[Arrays, Arrays | None]]],
    buckets: int,
    rounds: int = 1,
) -> Answers:
    """``emit`` gives, for each kind of keys, a chunk's rows as columns and their ascending buckets; the kind's ``settle`` gets the columns of
    a bucket's rows and gives answers in the same order, and figures of the bucket for chunk -1. There are ``rounds`` passes over the
    chunks, each for the buckets of one remainder."""

    def send(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for chunk, blobs in open_chunks(batches):
            for kind, (bucket, values) in enumerate(emit(chunk, blobs)):
                edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)).tolist()
                full = [b for b in range(turn, buckets, rounds) if edges[b] < edges[b + 1]]
                for some in (full[i : i + 64] for i in range(0, len(full), 64)):
                    sent = [pack({k: v[edges[b] : edges[b + 1]] for k, v in values.items()}) for b in some]
                    names = pa.array([kind * buckets + b for b in some], pa.int32())
                    yield pa.RecordBatch.from_arrays([names, pa.array([chunk] * len(some), pa.int64()), pa.array(sent, pa.binary())], ["bucket", "chunk", "payload"])

    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])

    def gather(table: pa.Table) -> pa.Table:
        keep_memory()
        table = table.sort_by("chunk")
        chunk, bucket = table.column("chunk").to_pylist(), table.column("bucket").to_pylist()
        each = [unpack(x.as_buffer()) for x in table.column("payload")]
        n = [len(next(iter(x.values()))) for x in each]
        values = {k: np.concatenate([x[k] for x in each]) for k in each[0]}
        out, figures = settle[bucket[0] // buckets](values)
        ends = np.cumsum(n)
        rows = [pack({k: v[b - a : b] for k, v in out.items()}) for a, b in zip(n, ends.tolist(), strict=True)]
        if figures is not None:
            rows, chunk, bucket = [*rows, pack(figures)], [*chunk, -1], [*bucket, bucket[0]]
        del each, values, out
        release()
        return pa.Table.from_arrays([pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(rows, pa.binary())], schema=schema)

    paths = tuple(scratch(chunks.sparkSession, label) for _ in range(rounds))
    for turn, path in enumerate(paths):
        with shuffle_freed(chunks.sparkSession):
            (
                chunks.mapInArrow(partial(send, turn=turn), "bucket int, chunk bigint, payload binary")
                .groupBy("bucket").applyInArrow(gather, "bucket int, chunk bigint, payload binary")
                .repartition("chunk").write.partitionBy("chunk").option("compression", "zstd").parquet(path)
            )
    return Answers(paths, buckets)


def distinct_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct values, index of each value among them). Where a value and its place fit in 64 bits, both are sorted as one
    number, and hashes by their upper bits, which nearly always part them."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    bits = np.uint64(len(x).bit_length())
    x = x.astype(np.uint64)
    over = max(int(x.max()).bit_length() + int(bits) - 64, 0)
    order = (np.sort((x >> np.uint64(over)) << bits | np.arange(len(x), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    x = x[order]
    if over and (x[1:] < x[:-1]).any():
        again = np.argsort(x, kind="stable")
        x, order = x[again], order[again]
    new = np.concatenate(([True], x[1:] != x[:-1]))
    of = np.empty(len(x), np.int64)
    of[order] = np.cumsum(new) - 1
    return x[new], of
