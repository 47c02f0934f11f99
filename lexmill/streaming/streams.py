"""Structured Streaming forms of the event operators. (W14, W15, K9, J15, N13, section 2.12)

These extend the batch operators to streams: the same input gives the same rows, late rows beyond the watermark apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, key: str, at: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """W15 with windows aligned to the clock."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_seen(events: DataFrame, id_: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Each id once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([id_])


def anchored_limit(events: DataFrame, key: str, at: str, seconds: int = 60, limit: int = 60) -> DataFrame:
    """W15 as counters with a time to live: a window opens with a key's first request and ends ``seconds`` later; rows are
    (key, at, n, allowed)."""
    kind = events.schema[key].dataType.simpleString()

    def count(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(batches).sort_values(at)
        out = []
        for t in rows[at]:
            now = int(t.timestamp() * 1_000_000)
            if opened is None or now >= opened + seconds * 1_000_000:
                opened, n = now, 0
            n += 1
            out.append((keys[0], t, n, n <= limit))
        state.update((opened, n))
        yield pd.DataFrame(out, columns=[key, at, "n", "allowed"])

    schema = f"{key} {kind}, {at} timestamp, n int, allowed boolean"
    return events.select(key, at).groupBy(key).applyInPandasWithState(count, schema, "opened long, n int", "append", GroupStateTimeout.NoTimeout)


def gap_states(actions: DataFrame) -> DataFrame:
    """Actions (gap_id, action) to the gap's state after each batch: (gap_id, tier, status)."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tier, status = state.get if state.exists else (0, "open")
        for rows in batches:
            for action in rows["action"]:
                if status in ("resolved", "permanent"):
                    break
                if action == "escalate":
                    tier, status = (tier, "blocked") if tier >= 4 else (tier + 1, "in_progress")
                elif action in ("resolve", "permanent"):
                    status = {"resolve": "resolved"}.get(action, action)
        state.update((tier, status))
        yield pd.DataFrame([(keys[0], tier, status)], columns=["gap_id", "tier", "status"])

    return actions.groupBy("gap_id").applyInPandasWithState(step, "gap_id long, tier int, status string", "tier int, status string", "update", GroupStateTimeout.NoTimeout)


def buffered_append(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """K9: append to Parquet each ``every`` interval, or all that is there and stop."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def fan_out_stream(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A stream of events joined to the static subscriptions."""
    from ..operators.resolve import fan_out

    return fan_out(events, subscriptions)
