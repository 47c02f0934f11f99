"""Stateful streams with timers: a log that is flushed when it is full or old, and deliveries that are tried again.

State is kept by key in RocksDB under the query's checkpoint, so a restarted query goes on with what was buffered, and a key's state is only what is open: at
most ``size`` entries of a buffer, or a subscription's deliveries of the last day. Timers are in processing time: they fire in the micro-batch after they are due."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Entries and age at which a buffer is flushed.
SIZE, SECONDS = 100, 5
#: Attempts after the first, seconds between them, failures that disable a subscription.
RETRIES, RETRY_SECONDS, MAX_FAILURES = 3, 2, 10
DAY_MS = 86_400_000
STORE = "spark.sql.streaming.stateStore.providerClass"


def with_state(spark: SparkSession) -> SparkSession:
    """The state store that these streams need, for queries that start from now on."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def run_for(query: StreamingQuery, rows: int, seconds: float = 600) -> None:
    """Let a query take in so many rows, then stop it: one with timers always has another batch, so it doesn't end by itself."""
    end, seen = time.time() + seconds, {}
    try:
        while sum(seen.values()) < rows:
            if time.time() > end or query.exception():
                raise RuntimeError(f"{sum(seen.values())} of {rows} rows were taken in: {query.exception()}")
            seen |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
            time.sleep(0.1)
    finally:
        query.stop()


class Buffer(StatefulProcessor):
    """K9: entries of a buffer until there are ``size`` of them, or until the oldest is ``seconds`` old."""

    def __init__(self, entry: StructType, size: int, seconds: float):
        self.entry, self.size, self.wait = entry, size, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", self.entry)
        self.flushes = handle.getValueState("flushes", StructType([StructField("n", LongType())]))

    def _out(self, key: tuple, rows: list[tuple], reason: str) -> pd.DataFrame:
        n = (self.flushes.get()[0] if self.flushes.exists() else 0) + 1
        self.flushes.update((n,))
        out = pd.DataFrame(rows, columns=self.entry.fieldNames())
        out.insert(0, "buffer", key[0])
        return out.assign(flush=n, reason=reason)

    def _stop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        names = self.entry.fieldNames()
        held = [tuple(r) for r in self.entries.get()] if self.entries.exists() else []
        old = bool(held)
        for batch in rows:
            for row in batch[names].itertuples(index=False, name=None):
                held.append(row)
                if len(held) >= self.size:
                    yield self._out(key, held, "full")
                    held, old = [], False
                    self._stop_timers()
        if held:
            self.entries.put([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in held])
            if not old:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        elif self.entries.exists():
            self.entries.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.entries.exists() and (held := [tuple(r) for r in self.entries.get()]):
            self.entries.clear()
            yield self._out(key, held, "time")

    def close(self) -> None:
        pass


def flushed(entries: DataFrame, buffers: int = 1, size: int = SIZE, seconds: float = SECONDS, by: Column | None = None) -> DataFrame:
    """K9: (buffer, the entry's columns, flush, reason): entries leave their buffer ``full`` or by ``time``, numbered by flush. Entries are dealt to ``buffers`` buffers by the hash of
    the whole entry, as a service has one in each of its processes, or to the buffer that the number ``by`` names."""
    names = entries.columns
    number = (by if by is not None else F.pmod(F.xxhash64(*names), F.lit(buffers))).cast("int")
    out = StructType([StructField("buffer", IntegerType()), *entries.schema.fields, StructField("flush", LongType()), StructField("reason", StringType())])
    return entries.withColumn("buffer", number).groupBy("buffer").transformWithStateInPandas(Buffer(StructType(list(entries.schema.fields)), size, seconds), out, "Append", "processingTime")


class Deliveries(StatefulProcessor):
    """Sends, retries and the count of failures of a subscription."""

    def __init__(self, retries: int, seconds: float, most: int):
        self.retries, self.wait, self.most = retries, int(seconds * 1000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "failures int, active boolean")
        self.attempts = handle.getMapState("attempts", "delivery string", "n int, due long", DAY_MS)  # what is never answered goes after a day

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["sub", "delivery", "action", "attempt", "failures"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        failures, active = self.state.get() if self.state.exists() else (0, True)
        out, now = [], timerValues.getCurrentProcessingTimeInMs()
        said = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for delivery, kind in zip(said["delivery"], said["kind"], strict=True):
            known = self.attempts.containsKey((delivery,))
            if kind == "event":
                if active and not known:
                    self.attempts.updateValue((delivery,), (1, 0))
                    out.append((delivery, "send", 1, failures))
                elif not active:
                    out.append((delivery, "skip", 0, failures))
            elif kind == "ok" and known:
                failures = 0
                self.attempts.removeKey((delivery,))
            elif kind == "fail" and known:
                n = self.attempts.getValue((delivery,))[0]
                if n <= self.retries and active:
                    self.attempts.updateValue((delivery,), (n, now + self.wait))
                    self.handle.registerTimer(now + self.wait)
                else:
                    self.attempts.removeKey((delivery,))
                    failures += 1
                    if failures >= self.most and active:
                        active = False
                        out.append((delivery, "disable", n, failures))
        self.state.update((int(failures), bool(active)))
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        failures, active = self.state.get()
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (delivery,), (n, due) in list(self.attempts.iterator()):
            if 0 < due <= now:
                self.attempts.updateValue((delivery,), (n + 1, 0))
                out.append((delivery, "send" if active else "skip", n + 1, failures))
        if out:
            yield self._frame(key, sorted(out))

    def close(self) -> None:
        pass


def deliveries(said: DataFrame, retries: int = RETRIES, seconds: float = RETRY_SECONDS, most: int = MAX_FAILURES) -> DataFrame:
    """Rows (sub, delivery, kind, seq) of events to deliver (``event``) and of how attempts ended (``ok``, ``fail``), in order of ``seq``, to actions (sub, delivery, action, attempt, failures): ``send`` an
    attempt, ``skip`` an event of a disabled subscription, ``disable`` it. A failed attempt is made again after ``seconds``, up to ``retries`` times; a delivery whose attempts
    all failed counts as a failure, a success sets the count to 0, and ``most`` failures disable the subscription."""
    out = "sub long, delivery string, action string, attempt int, failures int"
    return said.groupBy("sub").transformWithStateInPandas(Deliveries(retries, seconds, most), out, "Append", "processingTime")
