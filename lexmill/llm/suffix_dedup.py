"""Repeated byte strings by bucket-pointer refinement over q-gram buckets.

A position's bucket is named by a 64-bit value of its q-gram. A bucket is refined by the name of the bucket at a later offset
of the same text: 13-grams at i and i + 13 name the 26-gram at i; 26-grams at i and i + 24 name the 50-byte string at
i. A bucket whose members are all of one document is final: nothing in it is repeated. Only members of other ones go to the
next refinement, which reuses the names that the one before has given.

Rows for all suffixes would be many times the corpus. Of each 25 consecutive 26-grams the least is the anchor of the 50-byte
string that they fill, so equal strings have equal anchors at equal offsets, and only anchors are bucketed; consecutive
strings with one anchor are a run.

1. Initial buckets: the 26-grams of anchors, with the least and the largest doc_id of each. Buckets of several documents
   are open; their members are joined back to the texts.
2. Runs of open buckets are refined by the names at their first and last string, which fix all their bytes (128 bits with the
   bucket's). A run that an earlier document also has is repeated whole. If its bucket has other refinements too (ends of passages),
   the first document's strings stay open.
3. A string has 12 bytes before its anchor or 12 bytes after it. Open runs are refined by the names of the buckets 12 before and 12
   after the anchor; the strings on a side that no other document has are final.
4. Strings still open are refined one by one, by the names of the buckets at i and i + 24 (128 bits). A string that an earlier document has
   is repeated.

Each step is a partial aggregation and a join on bucket names, so a frequent passage is counted before it is shuffled, and its
rows can be split. Exact copies of a text are settled by digest before; each distinct text takes part once, under its
smallest doc_id.

Defined cases: null and empty texts have 0 bytes and nothing removed; texts under 50 bytes are never changed; a
document repeats only what starts in one with a smaller doc_id, so rows with one doc_id don't remove from each other,
and a null doc_id comes after all others; repeated rows get the same result; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, bounded, distinct_texts, forget, saved
from ._encode import expand, pieces_of
from ._words import M1, M2, M3, distinct, mix

LENGTH, Q, STEP = 50, 26, 25  # STEP: q-grams in a string of LENGTH
BLOCK = 256 << 10
LAST = np.iinfo(np.int64).max
_bytes = mix(np.arange(1, 257, dtype=np.uint64) * M1)
HALF = (LENGTH - Q) // 2  # bytes beside an anchor's q-gram that a string has on one side at least
RUNS = "bucket bigint, context bigint, rep bigint, t bigint, lo int, size int, at int, before bigint, after bigint"
STRINGS = "bucket bigint, later bigint, rep bigint, t bigint, lo int"
RESULT = "t bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def refine(names: np.ndarray, offset: int) -> np.ndarray:
    """Names of the strings that a bucket and the bucket ``offset`` later fill."""
    return mix(names[:-offset] * M1 + names[offset:])


def gram_names(data: np.ndarray) -> np.ndarray:
    """Of the 26-gram at each byte."""
    h1 = _bytes[data]

    def longer(a: np.ndarray, b: np.ndarray, la: int, lb: int) -> np.ndarray:
        n = len(data) - la - lb + 1
        return a[:n] * np.uint64(pow(int(M1), lb, 1 << 64)) + b[la : la + n]

    h2 = longer(h1, h1, 1, 1)
    h4 = longer(h2, h2, 2, 2)
    h13 = mix(longer(longer(longer(h4, h4, 4, 4), h4, 8, 4), h1, 12, 1))
    return refine(h13, 13)


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys."""
    done, got = 1, keys
    while done * 2 <= width:
        got = np.minimum(got[:-done], got[done:])
        done *= 2
    return np.minimum(got[: len(keys) - width + 1], got[width - done :]) if done < width else got


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(26-gram names, anchor, first string, last string, text) of the runs in the texts that ``offsets`` part."""
    n, none = len(data) - LENGTH + 1, np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none, none
    names = gram_names(data)
    low = np.uint64((1 << max(24, int(len(data)).bit_length())) - 1)
    anchor = (least((names & ~low) | np.arange(len(names), dtype=np.uint64), STEP) & low).astype(np.int64)
    inside = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n) >= LENGTH
    at = np.flatnonzero(inside)
    if not len(at):
        return names, none, none, none, none
    new = np.concatenate(([True], (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)))
    lo, hi = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    return names, anchor[lo], lo, hi, np.searchsorted(offsets, lo, "right") - 1


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, offsets of texts) in blocks that stay in the cache; a text is never cut."""
    for batch in (x for b in batches for x in pieces_of(b, "text", BLOCK)):
        text = batch.column("text")
        raw = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        yield batch, np.frombuffer(text.buffers()[2] or b"", np.uint8)[raw[0] : raw[-1]], raw - raw[0]


def gathered(rows: Iterator[tuple[np.ndarray, ...]], make: Callable[..., pa.RecordBatch], size: int = 500_000) -> Iterator[pa.RecordBatch]:
    """``make`` of the columns of several blocks, so that few batches go to Spark."""
    held, n = [], 0
    for x in rows:
        held.append(x)
        n += len(x[0])
        if n >= size:
            yield make(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield make(*map(np.concatenate, zip(*held, strict=True)))


def ids(column: pa.Array) -> np.ndarray:
    """doc_ids; null is the last."""
    return column.fill_null(LAST).to_numpy()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def open_buckets(texts: DataFrame) -> DataFrame:
    """(bucket) of anchors that several documents share."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch, data, offsets in blocks(batches):
                names, anchor, _, _, text = runs_of(data, offsets)
                yield names[anchor], ids(batch.column("rep"))[text]

        def make(bucket: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((rep, bucket))
            b, r = bucket[order], rep[order]
            first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(b)) - 1 if len(b) else first
            return pa.RecordBatch.from_arrays([signed(b[first]), pa.array(r[first]), pa.array(r[last])], ["bucket", "lo", "hi"])

        yield from gathered(parts(), make, 2_000_000)

    rows = texts.mapInArrow(send, "bucket bigint, lo bigint, hi bigint").groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return saved(rows.where("lo < hi").select("bucket"), "suffix-buckets")


def open_members(texts: DataFrame, buckets: DataFrame) -> DataFrame:
    """(t, buckets): the open ones of each text, no more than it has anchors."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch, data, offsets in blocks(batches):
                names, anchor, _, _, text = runs_of(data, offsets)
                yield names[anchor], batch.column("t").to_numpy()[text]

        yield from gathered(parts(), lambda b, t: pa.RecordBatch.from_arrays([signed(b), pa.array(t)], ["bucket", "t"]))

    rows = saved(texts.mapInArrow(send, "bucket bigint, t bigint").join(buckets, "bucket"), "suffix-members")
    out = saved(rows.groupBy("t").agg(F.collect_set("bucket").alias("buckets")), "suffix-members")
    forget(rows, buckets)
    return out


def open_runs(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The runs of open buckets that are repeated whole, or (not whole) whose strings stay open: bucket, rep, t, lo, size (strings after
    the first), at (place of the anchor), names before and after it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch, data, offsets in blocks(batches):
                names, p, lo, hi, text = runs_of(data, offsets)
                bucket, wanted = names[p], batch.column("buckets")
                known = wanted.offsets.to_numpy()
                per = wanted.values.to_numpy().view(np.uint64)
                on = np.zeros(len(bucket), bool)
                edges = np.searchsorted(text, np.arange(len(offsets)))
                for i in np.flatnonzero(np.diff(edges)).tolist():
                    own = slice(edges[i], edges[i + 1])
                    on[own] = np.isin(bucket[own], per[known[i] : known[i + 1]])
                p, lo, hi, text, bucket = p[on], lo[on], hi[on], text[on], bucket[on]
                string = refine(names, LENGTH - Q)
                context = mix(string[lo] * M1 + string[hi] * M2 + (p - lo).astype(np.uint64) * M3 + (hi - lo).astype(np.uint64))
                ends = offsets[text + 1]
                before = np.where(p - HALF >= offsets[text], names[np.maximum(p - HALF, 0)], 0)
                after = np.where(p + HALF + Q <= ends, names[np.minimum(p + HALF, len(names) - 1)], 0)
                yield bucket, context, ids(batch.column("rep"))[text], batch.column("t").to_numpy()[text], lo - offsets[text], hi - lo, p - lo, before, after

        def make(*columns: np.ndarray) -> pa.RecordBatch:
            bucket, context, rep, t, lo, size, at, before, after = columns
            small = [pa.array(x.astype(np.int32)) for x in (lo, size, at)]
            return pa.RecordBatch.from_arrays([signed(bucket), signed(context), pa.array(rep), pa.array(t), *small, signed(before), signed(after)], [x.split()[0] for x in RUNS.split(", ")])

        yield from gathered(parts(), make)

    rows = saved(texts.join(members, "t").select("t", "rep", "text", "buckets").mapInArrow(send, RUNS), "suffix-runs")
    each = saved(rows.groupBy("bucket", "context").agg(F.min("rep").alias("first")), "suffix-refined")
    several = each.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket", F.lit(True).alias("several"))
    refined = saved(each.join(several, "bucket", "left"), "suffix-refined")
    out = saved(rows.join(refined, ["bucket", "context"]).where("rep > first or several").withColumn("whole", F.col("rep") > F.col("first")).drop("context", "first", "several"), "suffix-open")
    forget(members, rows, each, refined)
    return out


def open_sides(runs: DataFrame) -> DataFrame:
    """(t, lo, size): the strings of open runs whose side of the anchor another document has too."""
    left = F.struct(F.lit(0).alias("side"), F.col("before").alias("name"), F.col("lo").alias("from"), (F.least("size", F.col("at") - HALF)).alias("more"))
    skip = F.greatest(F.col("at") - HALF, F.lit(0))
    right = F.struct(F.lit(1).alias("side"), F.col("after").alias("name"), (F.col("lo") + skip).alias("from"), (F.col("size") - skip).alias("more"))
    sides = runs.where("not whole").select("bucket", "rep", "t", F.inline(F.array(left, right))).where("more >= 0")
    shared = saved(sides.groupBy("bucket", "side", "name").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("bucket", "side", "name"), "suffix-sides")
    out = saved(sides.join(shared, ["bucket", "side", "name"]).select("t", F.col("from").alias("lo"), F.col("more").alias("size")), "suffix-sides")
    forget(shared)
    return out


def repeated_strings(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(t, lo) of the open strings that an earlier document has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch, data, offsets in blocks(batches):
                names, runs = gram_names(data), batch.column("runs")
                n = np.diff(runs.offsets.to_numpy())
                text = np.repeat(np.arange(len(batch)), n)
                flat = runs.flatten()
                lo, size = (flat.field(k).to_numpy().astype(np.int64) for k in ("lo", "size"))
                at, text = expand(offsets[text] + lo, size + 1), np.repeat(text, size + 1)
                at, first = np.unique(at, return_index=True)  # both sides of a run have the string between them
                text = text[first]
                yield names[at], names[at + LENGTH - Q], ids(batch.column("rep"))[text], batch.column("t").to_numpy()[text], at - offsets[text]

        def make(bucket: np.ndarray, later: np.ndarray, rep: np.ndarray, t: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([signed(bucket), signed(later), pa.array(rep), pa.array(t), pa.array(lo.astype(np.int32))], ["bucket", "later", "rep", "t", "lo"])

        yield from gathered(parts(), make)

    each = runs.groupBy("t").agg(F.collect_list(F.struct("lo", "size")).alias("runs"))  # a text's own
    rows = texts.join(each, "t").select("t", "rep", "text", "runs").mapInArrow(send, STRINGS)
    first = saved(rows.groupBy("bucket", "later").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("bucket", "later", "first"), "suffix-strings")
    out = saved(rows.join(first, ["bucket", "later"]).where("rep > first").select("t", "lo"), "suffix-strings")
    forget(first, runs)
    return out


def distinct_results(texts: DataFrame, keep: bool = False) -> DataFrame:
    """Per row of ``texts`` (t, rep, text): t, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep`` the kept bytes."""
    runs = open_runs(texts, open_members(texts, open_buckets(texts)))
    strings = repeated_strings(texts, open_sides(runs))
    spans = runs.where("whole").select("t", "lo", (F.col("lo") + F.col("size") + LENGTH).alias("end")).unionByName(strings.select("t", "lo", (F.col("lo") + LENGTH).alias("end")))
    spans = saved(spans.groupBy("t").agg(F.collect_list(F.struct("lo", "end")).alias("spans")), "suffix-spans")  # a text's own
    forget(runs, strings)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches):
            gone = batch.column("spans")
            n = np.where(gone.is_valid().to_numpy(zero_copy_only=False), np.diff(gone.offsets.to_numpy()), 0)
            flat = gone.flatten()
            text = np.repeat(np.arange(len(batch)), n)
            lo, end = (offsets[text] + flat.field(k).to_numpy().astype(np.int64) for k in ("lo", "end"))
            edge = np.bincount(lo, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
            cover = np.cumsum(edge[: len(data)]) > 0
            count = np.concatenate(([0], np.cumsum(cover)))
            begin = cover & ~np.concatenate(([False], cover[:-1])) if len(data) else cover
            inner = offsets[:-1][(offsets[:-1] < len(data)) & (np.diff(offsets) > 0)]
            begin[inner] = cover[inner]
            found = np.concatenate(([0], np.cumsum(begin)))
            removed = np.diff(count[offsets])
            kept = []
            for a, b, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist(), strict=True):
                part = data[a:b]
                kept.append((part[~cover[a:b]] if r else part).tobytes())
            columns = [batch.column("t"), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(np.diff(found[offsets]).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            names = ["t", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.join(spans, "t", "left").select("t", "text", "spans").mapInArrow(finish, RESULT + ", kept binary" * keep)


def repeated_spans(docs: DataFrame, keep: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep``, the kept bytes too."""
    texts = saved(distinct_texts(docs).select(F.monotonically_increasing_id().alias("t"), "*"), "suffix-texts")
    found = saved(distinct_results(texts, keep).join(texts.select("t", "digest", "rep"), "t"), "suffix-found")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")).join(bounded(found, 200, limit, F.octet_length("kept") if keep else None), "digest")
    copy = (F.col("n_bytes") >= LENGTH) & F.col("rep").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("rep"))
    return rows.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(copy, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept")] if keep else []),
    )
