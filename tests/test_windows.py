"""Anchored windows against a fold over each key's requests."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lexmill.operators import windows


def fold(times, width):
    """times in order: (opened, n) of each."""
    out, opened, n = [], None, 0
    for t in times:
        if opened is None or t >= opened + width:
            opened, n = t, 0
        n += 1
        out.append((opened, n))
    return out


@pytest.mark.parametrize(("seed", "width", "length"), [(1, 10, 200), (2, 3, 5000), (3, 1000, 900), (4, 7, 40_000)])
def test_anchored(spark, tmp_path, seed, width, length, widths=4):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", "c", "é"]), rng.randrange(length), i) for i in range(1500)]
    rows += [("burst", 5 + i % 3, 10_000 + i) for i in range(200)] + [("one", 0, 20_000), ("far", -50, 20_001), ("far", 10**7, 20_002), (None, 3, 20_003), ("x", None, 20_004), ("b", 3, 7)]
    frame = spark.createDataFrame(rows, "k string, t long, id long").repartition(5)
    want = set()
    for k in {r[0] for r in rows if r[0]}:
        own = sorted((t, i) for key, t, i in rows if key == k and t is not None)
        want |= {(k, i, t, *w) for (t, i), w in zip(own, fold([t for t, _ in own], width), strict=True)}
    got = [tuple(r) for r in windows.anchored(frame, "k", F.col("t"), "id", width, str(tmp_path / "w"), 64 if seed == 3 else widths).collect()]
    assert set(got) == want and len(got) == sum(t is not None and k is not None for k, t, _ in rows)


def test_batches_cut_anywhere(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        test_anchored(spark, tmp_path, 5, 10, 300, 2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def plain_limits(rows, per_minute, per_hour, own, minute, hour):
    out = set()
    for k in {r[0] for r in rows}:
        m, h = own.get(k, (None, None))
        m, h = per_minute if m is None else m, per_hour if h is None else h
        state = {"minute": None, "hour": None}

        def hit(name, t, width, limit):
            if state[name] is None or t >= state[name][0] + width:
                state[name] = (t, 1)
                return True
            state[name] = (state[name][0], state[name][1] + 1)
            return state[name][1] <= limit

        for _, t, i in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]):
            for name, width, limit in (("minute", minute, m), ("hour", hour, h)):
                if not hit(name, t, width, limit):
                    out.add((k, i, False, name, max(1, -(-(state[name][0] + width - t) // 1))))
                    break
            else:
                out.add((k, i, True, None, None))
    return out


def test_both_limits_with_overrides(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 2, 3]), rng.randrange(4000), i) for i in range(900)]
    origin = datetime(2024, 1, 1, tzinfo=timezone.utc)
    frame = spark.createDataFrame([(k, origin + timedelta(seconds=t), i) for k, t, i in rows], "user long, ts timestamp, id long")
    own = {2: (1, None), 3: (None, 0)}
    overrides = spark.createDataFrame([(k, *v) for k, v in own.items()], "key long, per_minute int, per_hour int")
    got = {tuple(r) for r in windows.rate_limited(frame, "user", "ts", "id", 3, 20, overrides).collect()}
    assert got == plain_limits(rows, 3, 20, own, 60, 3600)
    assert {g[3] for g in got} == {None, "minute", "hour"}
    assert windows.rate_limited(frame.limit(0), "user", "ts", "id", 3, 20).collect() == []


def test_a_busy_key_is_many_groups(spark, tmp_path):
    frame = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 7).alias("t"), "id")
    got = windows.anchored(frame, "k", F.col("t"), "id", 100, str(tmp_path / "w"))
    assert got.where("key = 0").count() == 10_000
    spans = spark.read.parquet(str(tmp_path / "w" / "nodes")).where("key = 0").select("span").distinct().count()
    assert spans > 30
    own = fold(range(0, 210_000, 21), 100)
    assert [(r["opened"], r["n"]) for r in got.where("key = 0").orderBy("at").collect()] == own
