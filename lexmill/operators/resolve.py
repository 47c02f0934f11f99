"""Entity resolution and set operations between catalogues. (J7-J16, J19, J20, section 2.7)

Containment is found by automata over names; names that match exactly are settled by an equi join first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_key
from . import names

#: Rows of a list of subscriptions that may be broadcast.
NAMES = 100_000


def new_titles(found: DataFrame, known: DataFrame, title: str) -> DataFrame:
    """Rows whose normal title isn't known; repeats within the batch stay. Titles of any length are joined by the hash of their key."""
    keys = known.select(title_hash(F.col(title)).alias("k")).distinct()
    return found.withColumn("k", title_hash(F.col(title))).join(keys, "k", "left_anti").drop("k")


def title_hash(title: Column) -> Column:
    return F.sha2(title_key(title), 256)


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys not there yet."""
    return wanted.join(have.select(key), key, "left_anti")


def name_to_slug(refs: DataFrame, laws: DataFrame, limit: int = names.SHARD_BYTES) -> DataFrame:
    """Refs (ref, name) to laws (slug, name, ord): exact, else the first law in order that contains or is contained; both ways by automata over the names."""
    laws = laws.where("name is not null").select(F.lower("name").alias("law"), "slug", F.col("ord").cast("long").alias("rank"))
    asked = refs.where("name is not null").select(F.lower("name").alias("n")).distinct()
    exact = asked.join(laws, F.col("n") == F.col("law")).groupBy("n").agg(F.min_by("slug", "rank").alias("exact"))
    rest = asked.join(exact, "n", "left_anti")
    inner = names.best_contained(rest, "n", laws.select(F.col("law").alias("name"), "rank"), limit).select(F.col("text").alias("n"), "rank")
    outer = names.best_holder(rest, "n", laws.select(F.col("law").alias("text"), "rank"), limit).select(F.col("name").alias("n"), "rank")
    first = inner.unionByName(outer).groupBy("n").agg(F.min("rank").alias("rank"))
    loose = first.join(laws.groupBy("rank").agg(F.min("slug").alias("loose")), "rank").select("n", "loose")
    found = asked.join(exact, "n", "left").join(loose, "n", "left").select("n", F.coalesce("exact", "loose").alias("slug"))
    return refs.join(found, F.lower("name") == F.col("n"), "left").drop("n")


def longest_contained(titles: DataFrame, known: DataFrame, title: str, name: str, order: str, limit: int = names.SHARD_BYTES) -> DataFrame:
    """The longest name that a title contains, in any case; the first in order on a tie. An automaton over the names finds all in one pass over a title."""
    upper, up = f"{title}__upper", F.upper(title)
    listed = known.where(F.col(name).isNotNull()).select(F.col(name).alias("nm"), F.upper(name).alias("name"), names.position(F.col(order), F.length(name)).alias("rank"))
    best = names.best_contained(titles.select(up.alias("t")), "t", listed.select("name", "rank"), limit)
    origin = listed.groupBy(F.col("name").alias("u"), F.col("rank").alias("r")).agg(F.min("nm").alias("related"))
    found = best.join(origin, (F.col("name") == F.col("u")) & (F.col("rank") == F.col("r"))).select(F.col("text").alias(upper), "related")
    return titles.withColumn(upper, up).join(found, upper, "left").drop(upper)


def merge_by_id_or_title(first: DataFrame, second: DataFrame, id_: str, title: str) -> DataFrame:
    """The first catalogue, and rows of the second that match neither its ids nor its normal titles."""
    keys = first.select(title_key(F.col(title)).alias("k")).distinct()
    fresh = second.join(first.select(id_), id_, "left_anti").withColumn("k", title_key(F.col(title))).join(keys, "k", "left_anti").drop("k")
    return first.unionByName(fresh.select(*first.columns))


def merge_registry(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, change): new values win; change is added, updated or kept."""
    a, b = old.select(key, F.col(value).alias("was")), new.select(key, F.col(value).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNotNull() & (F.col("now") != F.col("was")), "updated").otherwise("kept")
    return a.join(b, key, "full_outer").select(key, F.coalesce("now", "was").alias(value), change.alias("change"))


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events (event, category) by subscription (sub, events, domain_filter); an empty filter or a blank category passes."""
    subs = subscriptions.select("sub", F.explode("events").alias("event"), "domain_filter")
    free = (F.size("domain_filter") == 0) | (F.coalesce("category", F.lit("")) == "") | F.array_contains("domain_filter", F.col("category"))
    few = not subs.isStreaming and subs.limit(NAMES + 1).count() <= NAMES  # more of them are joined by shuffle, where AQE splits a busy event
    return events.join(F.broadcast(subs) if few else subs, "event").where(free).drop("domain_filter")


def common_articles(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: numbers of keys in both, only in a and only in b."""
    x, y = a.select(key).distinct().withColumn("a", F.lit(1)), b.select(key).distinct().withColumn("b", F.lit(1))
    return x.join(y, key, "full_outer").agg(F.count_if(F.expr("a = 1 and b = 1")).alias("matched"), F.count_if(F.expr("b is null")).alias("only_a"), F.count_if(F.expr("a is null")).alias("only_b"))


def union_first(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """2.7: sources one after another, the first of each key."""
    rows = parts[0].withColumn("src", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("src", F.lit(i)))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("src"))).where("r = 1").drop("r", "src")


def duplicate_groups(rows: DataFrame, text: str, id_: str) -> DataFrame:
    """(k: hash of the key, n, first id) of normal titles or texts that several rows have."""
    return rows.groupBy(title_hash(F.col(text)).alias("k")).agg(F.count("*").alias("n"), F.min(id_).alias("first_id")).where("n > 1")
