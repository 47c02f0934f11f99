"""Sinks and changes of tables as plans that give the new table.

A change is computed whole and written next to the old table; a reader sees either."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import escape_latex


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = (), keep_given: bool = False) -> DataFrame:
    """K1-K3: rows of ``new`` (the last per key in ``order``) replace those of ``old``; with ``keep_given`` only values that
    aren't blank do."""
    if order:
        new = new.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r = 1").drop("r")
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("o"))
    b = new.select(*keys, F.struct(*values).alias("n"))

    def value(c: str) -> Column:
        fresh = F.col("n").getField(c)
        if keep_given:
            return F.coalesce(F.when(F.trim(fresh.cast("string")) != "", fresh), F.col("o").getField(c)).alias(c)
        return F.when(F.col("n").isNotNull(), fresh).otherwise(F.col("o").getField(c)).alias(c)

    return a.join(b, list(keys), "full_outer").select(*keys, *map(value, values))


def upsert_by_id_or_key(old: DataFrame, new: DataFrame, id_: str, key: str) -> DataFrame:
    """K3: like ``upsert`` with ``keep_given``; a row of ``new`` whose id is unknown takes the id of the same ``key``."""
    known = old.select(F.col(id_).alias("old_id"), key).groupBy(key).agg(F.min("old_id").alias("old_id"))
    there = old.select(id_, F.lit(True).alias("there"))
    mapped = new.join(there, id_, "left").join(known, key, "left").withColumn(id_, F.when(F.col("there"), F.col(id_)).otherwise(F.coalesce("old_id", id_)))
    return upsert(old, mapped.select(*old.columns), [id_], [F.col(key)], keep_given=True)


def replace_partitions(old: DataFrame, new: DataFrame, key: str, parsed: DataFrame | None = None) -> DataFrame:
    """K4: rows of a key go when there are new ones, or when ``parsed`` says that it was parsed again, even to nothing."""
    again = (parsed if parsed is not None else new).select(key).distinct()
    return old.join(again, key, "left_anti").select(*old.columns).unionByName(new)


def article_documents(laws: DataFrame, texts: DataFrame, cap: int = 50_000) -> DataFrame:
    """K5: wide index rows; a law without articles is one document ``full_text`` of bounded length, tagged."""
    rows = laws.join(texts, "law_id", "left")
    given = F.col("article").isNotNull()
    blank = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    return rows.select(
        "law_id", F.coalesce("article", F.lit("full_text")).alias("article"), F.when(given, F.col("text")).otherwise(F.substring("raw_text", 1, cap)).alias("text"),
        blank("category", "unknown"), blank("status", "unknown"), blank("law_type", "legislative"), F.when(given, F.array().cast("array<string>")).otherwise(F.array(F.lit("raw_text"))).alias("tags"),
    )


def dedup_delete(laws: DataFrame, versions: DataFrame, valid_tiers: Sequence[str], key: str = "official_id") -> tuple[DataFrame, DataFrame]:
    """K7: laws that stay, and the versions of those."""
    bad = laws.where((F.col("tier") == "state") & F.col("state").isNull() | ~F.coalesce(F.col("tier"), F.lit("")).isin(*valid_tiers)).select(key)
    return laws.join(bad, key, "left_anti"), versions.join(bad, key, "left_anti")


def law_json(laws: DataFrame, articles: DataFrame, key: str, order: str) -> DataFrame:
    """K8: one JSON document per law with its articles in order."""
    parts = articles.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in articles.columns if c not in (key, order)]))).alias("articles"))
    return laws.join(parts, key, "left").select(key, F.to_json(F.struct(*laws.columns, "articles")).alias("document"))


def law_text(laws: DataFrame, articles: DataFrame, key: str, name: str, order: str, text: str) -> DataFrame:
    """K8: one plain text per law. A law's articles are gathered in a row, as its text is one value: it is bounded by the size of a
    document, and one beyond Spark's limit of a row (2 GB) has no such text."""
    body = articles.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias("body"))
    return laws.join(body, key, "left").select(key, F.concat_ws("\n\n", name, "body").alias("document"))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose natural key isn't there; running it again adds nothing."""
    fresh = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def gap_rows(report: DataFrame, today: Column) -> DataFrame:
    """Gaps of a report (state_name, permanent, transient): over 100 permanent ones are urgent; transient ones are tried
    again after a week."""
    kinds = F.array(
        F.struct(F.lit("permanent").alias("gap_type"), F.col("permanent").alias("n"), F.when(F.col("permanent") > 100, 2).otherwise(3).alias("priority"), F.lit(None).cast("date").alias("next_action_date")),
        F.struct(F.lit("transient").alias("gap_type"), F.col("transient").alias("n"), F.lit(3).alias("priority"), F.date_add(today, 7).alias("next_action_date")),
    )
    return report.select(F.col("state_name").alias("state"), F.inline(kinds)).where("n > 0")


def update_where(rows: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """UPDATE .. SET .. WHERE."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def write_json_batches(rows: DataFrame, path: str, records: int = 500) -> None:
    """JSON files of at most ``records`` rows."""
    rows.write.option("maxRecordsPerFile", records).json(path)


def get_or_create(old: DataFrame, new: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """K1: versions by (law, publication date): new ones are added; of one that is there only ``path`` changes, if it is given."""
    there = new.groupBy(*keys).agg(F.max(F.when(F.trim(path) != "", F.col(path))).alias("given"))
    return insert_absent(old.join(there, list(keys), "left").withColumn(path, F.coalesce("given", path)).select(*old.columns), new, keys)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small text in one file that is there whole or not at all: written beside its name, then renamed over it."""
    jvm = spark.sparkContext._jvm
    hadoop, conf = jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    there, fresh = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    fs = there.getFileSystem(conf)
    out = fs.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(there), how)


def read_small(spark: SparkSession, path: str) -> str | None:
    """What ``write_small`` has written last; null if nothing."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(there) else None


def save_checkpoint(spark: SparkSession, path: str, state: Mapping) -> None:
    """How far a job has come, as one JSON object."""
    write_small(spark, path, json.dumps(state))


def load_checkpoint(spark: SparkSession, path: str) -> dict:
    return json.loads(read_small(spark, path) or "{}")


def latex_document(laws: DataFrame, articles: DataFrame, key: str, name: str, order: str, label: str, text: str) -> DataFrame:
    """K8: one LaTeX source per law; bounded by the size of a document, like ``law_text``."""
    part = F.concat(F.lit("\\section*{"), escape_latex(F.col(label).cast("string")), F.lit("}\n"), escape_latex(F.coalesce(text, F.lit(""))))
    body = articles.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part.alias("p")))), lambda x: x.p), "\n\n").alias("body"))
    head, tail = F.lit("\\documentclass{article}\n\\begin{document}\n\\title{"), F.lit("\n\\end{document}\n")
    return laws.join(body, key, "left").select(key, F.concat(head, escape_latex(F.col(name)), F.lit("}\n\\maketitle\n"), F.coalesce("body", F.lit("")), tail).alias("document"))


class VersionedTable:
    """K6: versions of a table in folders, and a pointer to the live one: a small file that is replaced by a rename, so a reader finds the old version or the new one. The pointer also
    holds the order in which versions were published, by which old ones are pruned, and the last batch of each stream that is in the live one."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _pointer(self) -> dict:
        return json.loads(read_small(self.spark, f"{self.base}/live") or '{"live": null, "published": [], "batches": {}}')

    def _swap(self, version: str, keep: int, batches: Mapping[str, int]) -> None:
        was = self._pointer()
        published = [v for v in was["published"] if v != version] + [version]
        write_small(self.spark, f"{self.base}/live", json.dumps({"live": version, "published": published[-keep:] if keep else published, "batches": {**was["batches"], **batches}}))
        jvm = self.spark.sparkContext._jvm
        for old in published[:-keep] if keep else ():
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/v_{old}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def publish(self, rows: DataFrame, version: str, keep: int = 2) -> None:
        """Write a version whole, make it live, and prune to the ``keep`` published last. A folder of that name that never became live is replaced."""
        if version in self.versions():
            raise ValueError(f"version {version} is published")
        rows.write.mode("overwrite").parquet(f"{self.base}/v_{version}")
        self._swap(version, keep, {})

    def live(self) -> str | None:
        return self._pointer()["live"]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/v_{self.live()}")

    def versions(self) -> list[str]:
        """Published versions that are kept, in order of publication."""
        return self._pointer()["published"]

    def apply(self, batch: DataFrame, number: int, merge: Callable[[DataFrame | None, DataFrame], DataFrame], stream: str = "stream", keep: int = 2) -> bool:
        """Merge a stream's batch into the live version, once: a batch that is already in it changes nothing. Until the pointer is replaced, what was written counts for nothing and is written again."""
        was = self._pointer()
        if number <= was["batches"].get(stream, -1):
            return False
        version = f"{stream}_{number:012d}"
        merge(self.read() if was["live"] is not None else None, batch).write.mode("overwrite").parquet(f"{self.base}/v_{version}")
        self._swap(version, keep, {stream: number})
        return True

    def follow(self, stream: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str, name: str = "stream", keep: int = 2, every: str | None = None) -> StreamingQuery:
        """K1, K4, K11 as a stream: each micro-batch is merged into the live version. Spark may give a batch again after a failure; its number tells."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return stream.writeStream.foreachBatch(lambda batch, number: self.apply(batch, number, merge, name, keep) and None).option("checkpointLocation", checkpoint).trigger(**trigger).start()
