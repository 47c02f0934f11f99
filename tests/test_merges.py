"""Merged batches: a replayed batch changes nothing, whether the pointer was replaced or not."""

import pytest
from pyspark.sql import functions as F

from lexmill.plans import sinks


def merge(old, batch):
    """Not idempotent by itself: values add up."""
    rows = batch if old is None else old.unionByName(batch)
    return rows.groupBy("k").agg(F.sum("v").alias("v"))


def rows(table):
    return sorted(map(tuple, table.read().collect()))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    made = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    batch = lambda *x: spark.createDataFrame(list(x), "k string, v long")
    assert made.apply(batch(("a", 1)), 0, merge) and made.apply(batch(("a", 2), ("b", 5)), 1, merge)
    assert rows(made) == [("a", 3), ("b", 5)]
    assert not made.apply(batch(("a", 2), ("b", 5)), 1, merge) and not made.apply(batch(("a", 1)), 0, merge)
    assert rows(made) == [("a", 3), ("b", 5)]
    assert made.apply(batch(("a", 10)), 0, merge, "another")  # each stream has numbers of its own
    assert rows(made) == [("a", 13), ("b", 5)] and len(made.versions()) == 2


def test_a_failure_between_write_and_pointer(spark, tmp_path, monkeypatch):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    made = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    put = lambda *x: spark.createDataFrame(list(x), "k string, v long").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("k string, v long").parquet(source)
    put(("a", 1), ("b", 1))
    made.follow(stream(), merge, check).awaitTermination()
    put(("a", 5))
    swap = made._swap
    monkeypatch.setattr(made, "_swap", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception):
        made.follow(stream(), merge, check).awaitTermination()
    assert rows(made) == [("a", 1), ("b", 1)]  # written, not live
    monkeypatch.setattr(made, "_swap", swap)
    made.follow(stream(), merge, check).awaitTermination()
    assert rows(made) == [("a", 6), ("b", 1)]

    def late(*a):  # the pointer is replaced, then the driver is lost before Spark notes the batch as done
        swap(*a)
        raise RuntimeError("lost")

    put(("b", 7))
    monkeypatch.setattr(made, "_swap", late)
    with pytest.raises(Exception):
        made.follow(stream(), merge, check).awaitTermination()
    monkeypatch.setattr(made, "_swap", swap)
    made.follow(stream(), merge, check).awaitTermination()
    assert rows(made) == [("a", 6), ("b", 8)]


def test_versions_go_by_publication(spark, tmp_path):
    made = sinks.VersionedTable(spark, f"file://{tmp_path}/t")
    for v in ("8", "9", "10", "11"):
        made.publish(spark.createDataFrame([(v,)], "v string"), v, keep=2)
    assert made.versions() == ["10", "11"] and made.live() == "11" and made.read().first()["v"] == "11"
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v_")) == ["v_10", "v_11"]
    with pytest.raises(ValueError):
        made.publish(made.read(), "11")
