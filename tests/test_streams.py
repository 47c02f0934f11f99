"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from lexmill.streaming import streams


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def events(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 1, 59)] + [(2, "2024-01-01 02:00:00"), (9, "2024-01-03 00:00:00")], "user int, at string").select("user", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.parquet(path)
    return spark.readStream.schema("user int, at timestamp").parquet(path)


def test_windowed_counts(spark, tmp_path):
    got = {(r["user"], str(r["window_start"]), r["n"]) for r in run(spark, streams.windowed_counts(events(spark, tmp_path), "user", "at"), "w")}
    assert {(1, "2024-01-01 00:00:00", 3), (2, "2024-01-01 02:00:00", 1)} <= got


def test_anchored_limit(spark, tmp_path):
    got = sorted((r["user"], r["n"], r["allowed"]) for r in run(spark, streams.anchored_limit(events(spark, tmp_path), "user", "at", 120, 1), "a"))
    assert got == [(1, 1, True), (1, 1, True), (1, 2, False), (2, 1, True), (9, 1, True)]


def test_gap_states(spark, tmp_path):
    path = str(tmp_path / "gaps")
    spark.createDataFrame([(1, "escalate"), (1, "escalate"), (2, "resolve")], "gap_id long, action string").coalesce(1).write.parquet(path)
    got = {tuple(r) for r in run(spark, streams.gap_states(spark.readStream.schema("gap_id long, action string").parquet(path)), "g", "update")}
    assert got == {(1, 2, "in_progress"), (2, 0, "resolved")}


def test_buffered_append(spark, tmp_path):
    q = streams.buffered_append(events(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
