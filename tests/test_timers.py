"""Streams with timers: both triggers of the log, deliveries with retries and disabling, and recovery from the checkpoint."""

import time

import pytest

from lexmill.streaming import timers


@pytest.fixture
def stateful(spark):
    before = spark.conf.get(timers.STORE, None)
    yield timers.with_state(spark)
    spark.conf.set(timers.STORE, before) if before else spark.conf.unset(timers.STORE)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def wait_for(spark, path, schema, done, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        rows = [tuple(r) for r in spark.read.schema(schema).parquet(path).collect()]
        if done(rows):
            return rows
        time.sleep(0.5)
    raise AssertionError(rows)


def start(stream, path, checkpoint):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="300 milliseconds").start()


def test_log_is_flushed_when_full_or_old_and_survives_a_restart(stateful, tmp_path):
    spark, source, out, check = stateful, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema, kept = "id long, said string", "buffer int, id long, said string, flush long, reason string"
    make = lambda seconds: timers.flushed(spark.readStream.schema(schema).parquet(source), size=10, seconds=seconds)
    put(spark, source, [(i, f"s{i}") for i in range(13)], schema)
    query = start(make(3600), out, check)
    rows = wait_for(spark, out, kept, lambda r: len(r) >= 10)
    assert {r[3:] for r in rows} == {(1, "full")} and len(rows) == 10  # three wait
    query.stop()
    put(spark, source, [(i, None) for i in range(13, 21)], schema)  # 3 + 8: one flush, one entry is left
    query = start(make(3600), out, check)
    rows = wait_for(spark, out, kept, lambda r: len(r) >= 20)
    assert len({r[1] for r in rows}) == 20
    assert {r[3:] for r in rows} == {(1, "full"), (2, "full")}
    query.stop()


def test_log_is_flushed_by_time(stateful, tmp_path):
    spark, source, out = stateful, str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [(i, "x") for i in range(7)], "id long, said string")
    query = start(timers.flushed(spark.readStream.schema("id long, said string").parquet(source), size=100, seconds=2), out, str(tmp_path / "check"))
    rows = wait_for(spark, out, "buffer int, id long, said string, flush long, reason string", lambda r: len(r) >= 7)
    assert sorted(r[1] for r in rows) == list(range(7)) and {r[3:] for r in rows} == {(1, "time")}
    query.stop()


def test_deliveries(stateful, tmp_path):
    spark, source, out = stateful, str(tmp_path / "in"), str(tmp_path / "out")
    schema, kept = "sub long, delivery string, kind string, seq long", "sub long, delivery string, action string, attempt int, failures int"
    fails = [x for d in ("b", "c", "d") for x in [(1, d, "event"), (1, d, "fail")]]
    rows = [(1, "a", "event"), (1, "a", "fail"), (2, "z", "event"), (2, "z", "ok"), *fails]
    put(spark, source, [(*r, i) for i, r in enumerate(rows)], schema)
    query = start(timers.deliveries(spark.readStream.schema(schema).parquet(source), retries=1, seconds=1, most=3), out, str(tmp_path / "check"))
    got = wait_for(spark, out, kept, lambda r: sum(x[3] == 2 for x in r) == 4)  # each of the four is tried again by a timer
    assert {(x[0], x[1], x[3]) for x in got} == {(2, "z", 1), *((1, d, n) for d in "abcd" for n in (1, 2))}
    put(spark, source, [(1, "a", "fail", 20), (1, "b", "ok", 21), (1, "c", "fail", 22), (1, "d", "fail", 23), (1, "e", "event", 24)], schema)  # a fails for good, b sets the count to 0, c and d fail
    got = wait_for(spark, out, kept, lambda r: any(x[1] == "e" for x in r))
    assert (1, "e", "send", 1, 2) in got
    put(spark, source, [(1, "e", "fail", 30)], schema)
    wait_for(spark, out, kept, lambda r: (1, "e", "send", 2, 2) in r)
    put(spark, source, [(1, "e", "fail", 40), (1, "f", "event", 41), (2, "y", "event", 42)], schema)  # the third failure in a row disables
    got = wait_for(spark, out, kept, lambda r: any(x[1] == "f" for x in r) and any(x[1] == "y" for x in r))
    assert (1, "e", "disable", 2, 3) in got and (1, "f", "skip", 0, 3) in got and (2, "y", "send", 1, 0) in got
    query.stop()
