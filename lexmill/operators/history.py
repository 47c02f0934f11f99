"""Version history, deduplication, windows, paging by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def changelog(versions: DataFrame, key: str, at: str, tie: str, limit: int = 500) -> DataFrame:
    """Of the latest ``limit`` versions the latest of each law, with the date of the version before it in all history. The latest
    are taken first, so that only the history of their laws is read again: at most ``limit`` keys."""
    order = [F.col(at).desc_nulls_last(), F.col(tie).desc()]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    latest = versions.orderBy(*order).limit(limit).withColumn("r", first).where("r = 1").drop("r")
    some = latest.select(F.col(key), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie")).alias("last"))
    earlier = versions.select(key, F.struct(F.col(at).alias("at"), F.col(tie).alias("tie")).alias("version")).join(F.broadcast(some), key).where(F.col("version") < F.col("last"))
    previous = earlier.groupBy(key).agg(F.max("version").alias("v")).select(key, F.col("v.at").alias("previous_at"))
    return latest.join(previous, key, "left")


def with_previous(versions: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Every version with the date of the one before it."""
    return versions.withColumn("previous_at", F.lag(at).over(Window.partitionBy(key).orderBy(at, tie)))


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in source order, by partial aggregation."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), place).alias("row")).select("row.*")


def back_fill(rows: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row per key, each column from the first row that has it."""
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return rows.groupBy(key).agg(*[F.min_by(F.col(c), F.when(blank_to_null(F.col(c).cast("string")).isNotNull(), place)).alias(c) for c in columns])


def gaps(rows: DataFrame, key: str, number: str, more_than: int = 1) -> DataFrame:
    """(key, from, to): neighbours in order whose numbers are more than ``more_than`` apart."""
    previous = F.lag(number).over(Window.partitionBy(key).orderBy(number))
    return rows.select(key, number).distinct().withColumn("gap_from", previous).where(F.col(number) - F.col("gap_from") > more_than).select(key, "gap_from", F.col(number).alias("gap_to"))


def sample_per(rows: DataFrame, key: str, id_: str, n: int, seed: str = "sample") -> DataFrame:
    """N rows per key in an order fixed by a hash."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(order, id_))).where(F.col("r") <= n).drop("r")


def golden(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The longest name per key, the least on a tie."""
    return rows.groupBy(key).agg(F.min_by(name, F.struct(-F.length(name), F.col(name))).alias(name))


def most_recent(items: Column, new: Column, cap: int = 50) -> Column:
    """The list with an item moved to its front."""
    return F.slice(F.concat(F.array(new), F.array_remove(items, new)), 1, cap)


def toggle(items: Column, item: Column) -> Column:
    """Bookmark on or off."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def trailing_count(events: DataFrame, key: str, at: str, id_: str, seconds: int = 3600, limit: int = 10) -> DataFrame:
    """Events of the key in the ``seconds`` up to each, and when the next is allowed if there are ``limit``. Time is cut in
    spans of ``seconds``; a span is counted with a copy of the one before, so a busy key is many groups."""
    sec = F.unix_seconds(F.col(at).cast("timestamp"))
    rows = events.select(key, id_, at, sec.alias("sec"), F.floor(sec / seconds).alias("b"))
    rows = rows.select(key, id_, at, "sec", F.inline(F.array(F.struct(F.col("b").alias("span"), F.lit(True).alias("own")), F.struct((F.col("b") + 1).alias("span"), F.lit(False).alias("own")))))
    upto = Window.partitionBy(key, "span").orderBy("sec").rangeBetween(-seconds, 0)
    counted = rows.withColumn("n_trailing", F.count("*").over(upto)).withColumn("oldest", F.min(at).over(upto)).where("own")
    retry = F.when(F.col("n_trailing") >= limit, F.unix_seconds(F.col("oldest").cast("timestamp")) + seconds - F.col("sec"))
    return counted.select(key, id_, "n_trailing", retry.alias("retry_after"))


def fixed_windows(events: DataFrame, key: str, at: str, width: str = "1 minute", limit: int = 60) -> DataFrame:
    """Requests by key and aligned window, and how many are over the limit."""
    counts = events.groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("over"))


def latest_of(rows: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The latest row's columns per kind."""
    return rows.groupBy(key).agg(*[F.max_by(c, F.struct(at, c)).alias(c) for c in columns], F.max(at).alias(at))


def unread_first(rows: DataFrame, read: str, at: str) -> DataFrame:
    """W16."""
    return rows.orderBy(F.col(read).asc(), F.col(at).desc_nulls_last())


def valid_on(versions: DataFrame, day: Column) -> DataFrame:
    """The versions in force on a day; an open end has no bound."""
    return versions.where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)))
