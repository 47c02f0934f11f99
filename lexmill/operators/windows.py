"""Rate limits by windows that open with a key's first request, in batch.

A window opens with a request and holds the requests of the next ``width``; the first one after it opens the next. Openers are the orbit of the successor
pointer "first request at or after t + width". A key's time is cut into spans of 64 widths, so that a busy key is many groups. Within a span
pointers are followed in its task; between spans only the few requests in a span's first width can be where an orbit enters it: each of those points to where
its orbit enters a later span, and pointer doubling over these marks the ones on the key's own orbit. A last pass numbers the requests of each window.

Requests are shuffled twice by (key, span) for each width, and never gathered by key. Doubling takes as many rounds as the number of a key's spans has binary digits.

Defined cases: requests without a key or time are left out; requests of one time go by id; repeated rows are requests each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folders import folder, removed, stored

#: Widths of a span.
SPAN = 64
#: The least wait that is told, in seconds.
LEAST_WAIT = 1


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts): sorted rows regrouped so that those of one (key, span) come together; batches are joined only where a group goes on."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        key = rows.column("key").combine_chunks().dictionary_encode()
        key = (key.chunk(0) if isinstance(key, pa.ChunkedArray) else key).indices.to_numpy(zero_copy_only=False)
        span = rows.column("span").to_numpy()
        new = np.flatnonzero((key[1:] != key[:-1]) | (span[1:] != span[:-1])) + 1
        if held and (held[-1]["key"][-1].as_py(), held[-1]["span"][-1].as_py()) != (rows["key"][0].as_py(), rows["span"][0].as_py()):
            new = np.concatenate(([0], new))
        if not len(new):
            held.append(rows)
            continue
        ahead = pa.concat_tables([*held, rows.slice(0, new[0])])
        if len(ahead):
            yield ahead.combine_chunks(), np.zeros(1, np.int64)
        if len(new) > 1:
            yield rows.slice(new[0], new[-1] - new[0]), new[:-1] - new[0]
        held = [rows.slice(new[-1])]
    if held:
        yield pa.concat_tables(held).combine_chunks(), np.zeros(1, np.int64)


def _pointers(at: np.ndarray, span: np.ndarray, starts: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each row, end of each row's group, time in the span, next opener's row or the end) of sorted groups."""
    sizes = np.diff(np.append(starts, len(at)))
    group = np.repeat(np.arange(len(starts)), sizes)
    end = np.repeat(starts + sizes, sizes)
    inside = at - span * length
    x = group * (2 * length) + inside
    return group, end, inside, np.minimum(np.searchsorted(x, x + width), end)


def _enter(width: int, length: int):
    """Requests where an orbit may enter a span: one a time in its first width, and the first one after that; with the last opener of the orbit and the
    requests from there."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches):
            at, span = rows.column("at").to_numpy(), rows.column("span").to_numpy()
            group, end, inside, after = _pointers(at, span, starts, width, length)
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            new[starts] = True
            early = inside < width
            late = ~early & np.concatenate(([True], early[:-1] | (group[1:] != group[:-1])))
            some = np.flatnonzero(new & (early | late))
            last = some.copy()
            while (go := after[last] < end[last]).any():
                last[go] = after[last[go]]
            columns = [rows.column("key").combine_chunks().take(pa.array(some)), span[some], some - starts[group[some]], at[some], at[last], end[last] - last]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["key", "span", "pos", "at", "last_at", "tail"])

    return find


def _number(width: int, length: int):
    """Number the requests of each window: a group begins with its mark (kind 0: where the orbit enters, the window that is open, its requests so far)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches):
            kind = rows.column("kind").to_numpy()
            mark, own = rows.filter(pa.array(kind == 0)), rows.filter(pa.array(kind == 1)).combine_chunks()
            starts = starts - np.arange(len(starts))  # each group has one mark
            at, span = own.column("at").to_numpy(), own.column("span").to_numpy()
            group, end, _, after = _pointers(at, span, starts, width, length)
            get = lambda name: mark.column(name).fill_null(-1).to_numpy()
            enter, index, opens = get("pos"), np.arange(len(at)), np.zeros(len(at), bool)
            now = (starts + enter)[enter >= 0]
            while len(now):
                opens[now] = True
                now = after[now][after[now] < end[now]]
            opener = np.maximum.accumulate(np.where(opens, index, -1)) if len(at) else index
            here = opener >= starts[group]
            n = np.where(here, index - opener, get("tail")[group] + index - starts[group]) + 1
            opened = np.where(here, at[np.maximum(opener, 0)], get("last_at")[group])
            yield pa.RecordBatch.from_arrays([own.column(c).combine_chunks() for c in ("key", "id", "at")] + [pa.array(opened), pa.array(n)], ["key", "id", "at", "opened", "n"])

    return count


def _rows(events: DataFrame, key: str, at: Column, id_: str, length: int) -> DataFrame:
    return events.select(F.col(key).alias("key"), F.col(id_).alias("id"), at.alias("at")).where("key is not null and at is not null").withColumn("span", F.expr(f"(at - pmod(at, {length})) div {length}"))


def _entries(nodes: DataFrame, width: int, path: str) -> DataFrame:
    """(key, span, pos, last_at, tail) for each span that has requests: where the key's orbit enters it, if it does, and the window that is open before."""
    spans = stored(
        nodes.select("key", "span").distinct().withColumns({f"next{i}": F.lead("span", i).over(Window.partitionBy("key").orderBy("span")) for i in (1, 2)}), f"{path}/spans"
    )  # a row for each 64 widths in which a key has requests
    asked = nodes.join(spans, ["key", "span"]).where("next1 is not null").select("key", F.col("next1").alias("to"), (F.col("last_at") + width).alias("at"), F.lit(0).alias("kind"), "span", "pos", "next2")
    there = nodes.select("key", F.col("span").alias("to"), "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("span"), "pos", F.lit(None).cast("long").alias("next2"))
    falling = Window.partitionBy("key", "to").orderBy(F.desc("at"), F.desc("kind"))
    met = asked.unionByName(there).withColumn("hit", F.last(F.when(F.col("kind") == 1, F.col("pos")), True).over(falling)).where("kind = 0")
    links = met.select("key", "span", "pos", F.when(F.col("hit").isNotNull(), F.col("to")).otherwise(F.col("next2")).alias("to_span"), F.coalesce("hit", F.lit(0)).cast("long").alias("to_pos"))
    jump = stored(links.where("to_span is not null"), f"{path}/jump0")
    marked = stored(nodes.groupBy("key").agg(F.min("span").alias("span")).withColumn("pos", F.lit(0).cast("long")), f"{path}/marked0")
    step = 0
    while jump.take(1):
        step += 1
        on = jump.join(marked, ["key", "span", "pos"]).select("key", F.col("to_span").alias("span"), F.col("to_pos").alias("pos"))
        marked = stored(marked.unionByName(on), f"{path}/marked{step}")
        far = jump.select("key", F.col("span").alias("to_span"), F.col("pos").alias("to_pos"), F.col("to_span").alias("far_span"), F.col("to_pos").alias("far_pos"))
        jump = stored(jump.join(far, ["key", "to_span", "to_pos"]).select("key", "span", "pos", F.col("far_span").alias("to_span"), F.col("far_pos").alias("to_pos")), f"{path}/jump{step}")
    on_orbit = marked.join(nodes, ["key", "span", "pos"]).select("key", "span", "pos", F.struct("last_at", "tail").alias("open"))
    before = F.last("open", True).over(Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    return spans.select("key", "span").join(on_orbit, ["key", "span"], "left").withColumn("before", before).select("key", "span", "pos", "before.last_at", "before.tail")


def anchored(events: DataFrame, key: str, at: Column, id_: str, width: int, path: str, widths: int = SPAN) -> DataFrame:
    """(key, id, at, opened, n): each request's window by its opening time, and its number there. ``at`` and ``width`` are whole numbers of one unit; tables between steps stand below ``path``."""
    length = widths * width
    rows = _rows(events, key, at, id_, length)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    order = rows.select("key", "span", "at").repartition("key", "span").sortWithinPartitions("key", "span", "at")
    nodes = stored(order.mapInArrow(_enter(width, length), f"key {kinds['key']}, span long, pos long, at long, last_at long, tail long"), f"{path}/nodes")
    entries = stored(_entries(nodes, width, path), f"{path}/entries")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    marks = entries.select("key", "span", F.lit(0).alias("kind"), none("at", "long"), none("id", kinds["id"]), "pos", "last_at", "tail")
    own = rows.select("key", "span", F.lit(1).alias("kind"), "at", "id", none("pos", "long"), none("last_at", "long"), none("tail", "long"))
    both = marks.unionByName(own).repartition("key", "span").sortWithinPartitions("key", "span", "kind", "at", "id")
    return both.mapInArrow(_number(width, length), f"key {kinds['key']}, id {kinds['id']}, at long, opened long, n long")


def rate_limited(events: DataFrame, key: str, at: str, id_: str, per_minute: int, per_hour: int, overrides: DataFrame | None = None, minute: int = 60, hour: int = 3600, path: str | None = None) -> DataFrame:
    """(key, id, allowed, refused_by, wait): each request against the minute's counter, and, if that lets it pass, the hour's. A counter is set by the first request that it sees, which
    always passes, and expires ``minute`` or ``hour`` seconds later; refused requests count. ``overrides`` (key, per_minute, per_hour) has limits of
    single keys, null for the general one. ``wait`` is the time until the counter that refuses expires, in whole seconds, at least one."""
    base = path or folder(events.sparkSession)
    limits = None if overrides is None else overrides.select(F.col("key").alias("of"), F.col("per_minute").alias("m"), F.col("per_hour").alias("h"))

    def counted(rows: DataFrame, name: str, width: int, general: int, own: str) -> DataFrame:
        found = anchored(rows, "key", F.col("at"), "id", width * 1_000_000, f"{base}/{name}")
        found = found.withColumn("most", F.lit(general)) if limits is None else found.join(limits, F.col("key") == F.col("of"), "left").withColumn("most", F.coalesce(own, F.lit(general)))
        ends = F.ceil((F.col("opened") + width * 1_000_000 - F.col("at")) / 1_000_000)
        return found.select("key", "id", "at", ((F.col("n") <= F.col("most")) | (F.col("n") == 1)).alias("allowed"), F.greatest(ends, F.lit(LEAST_WAIT)).alias("wait"))

    rows = events.select(F.col(key).alias("key"), F.col(id_).alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    first = stored(counted(rows, "minute", minute, per_minute, "m"), f"{base}/first")
    second = counted(first.where("allowed"), "hour", hour, per_hour, "h")
    refused = lambda by: F.when(~F.col("allowed"), by).alias("refused_by")
    out = first.where("not allowed").select("key", "id", "allowed", refused("minute"), "wait").unionByName(second.select("key", "id", "allowed", refused("hour"), F.when(~F.col("allowed"), F.col("wait")).alias("wait")))
    return out.select(F.col("key").alias(key), F.col("id").alias(id_), "allowed", "refused_by", "wait")


def forget(spark, path: str) -> None:
    """Remove the tables between steps, when what came of them is stored."""
    removed(spark, path)
