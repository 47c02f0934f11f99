"""Analytics, coverage, gap and quality dashboards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import grade, safe_pct
from .parse import akn_article_count, content_type


def top_queries(log: DataFrame, query: str, results: str, n: int = 20, zero_only: bool = False) -> DataFrame:
    """Most frequent queries with their mean number of results, or those without results."""
    log = log.where(F.col(results) == 0) if zero_only else log
    return log.groupBy(query).agg(F.count("*").alias("n"), F.bround(F.avg(results), 1).alias("avg_results")).orderBy(F.desc("n"), query).limit(n)


def volume_by_day(log: DataFrame, at: str, ms: str, zone: str = "UTC") -> DataFrame:
    """Requests and mean time per local day; a mean of 0 is null."""
    day = F.to_date(F.from_utc_timestamp(at, zone))
    return log.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.nullif(F.bround(F.avg(ms), 0), F.lit(0.0)).alias("avg_ms"))


def grouping_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a, by b and in all, in one scan."""
    view = rows.select(F.col(a).alias("a"), F.col(b).alias("b"))
    return view.groupingSets([["a"], ["b"], []], "a", "b").agg(F.grouping_id().alias("gid"), F.count("*").alias("n")).select("a", "b", F.col("gid").cast("int").alias("gid"), "n")


def gap_dashboard(gaps: DataFrame, now: Column) -> DataFrame:
    """Counts by status, actionable and overdue, one row."""
    active = F.col("status").isin("open", "in_progress")
    return gaps.agg(
        F.count("*").alias("total"), F.count_if(active).alias("actionable"), F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count_if(active & (F.col("next_action_date") < now)).alias("overdue"),
    )


def gap_breakdown(gaps: DataFrame, kinds: Sequence[str] = ("status", "current_tier", "level", "gap_type")) -> DataFrame:
    """(kind, key, n) of each breakdown, in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in kinds])
    return gaps.select(F.inline(pairs)).groupBy("kind", "key").agg(F.count("*").alias("n"))


def top_gaps(gaps: DataFrame, id_: str = "id", n: int = 10) -> DataFrame:
    """The first actionable gaps by priority, then tier; ties by id."""
    return gaps.where(F.col("status").isin("open", "in_progress")).orderBy("priority", "current_tier", id_).limit(n)


def by_city(scraped: DataFrame, db: DataFrame, key: str = "city") -> DataFrame:
    """Scraped cities (city, n) with what the database has of each; 0 where it has none."""
    return scraped.select(key, F.col("n").alias("scraped")).join(db.select(key, F.col("n").alias("in_db")), key, "left").withColumn("in_db", F.coalesce("in_db", F.lit(0)))


def health_summary(sources: DataFrame) -> DataFrame:
    """A15."""
    kinds = {k: F.count_if(F.col("status") == k).alias(k) for k in ("healthy", "degraded", "down", "unknown")}
    return sources.agg(F.count("*").alias("total"), *kinds.values(), F.count_if(F.col("last_check").isNull()).alias("never_checked"))


def coverage_views(views: DataFrame, sources: DataFrame) -> DataFrame:
    """Views (view, universe, components array<struct<key, field>>) against sources (key, field, n)."""
    parts = views.select("view", "universe", F.inline("components"))
    have = parts.join(sources, ["key", "field"], "left").groupBy("view", "universe").agg(F.sum(F.coalesce("n", F.lit(0))).alias("have"))
    return have.withColumn("pct", safe_pct(F.col("have"), F.col("universe")))


def with_total(rows: DataFrame, label: str, have: str, universe: str) -> DataFrame:
    """The table and a row of sums."""
    total = rows.agg(F.lit("total").alias(label), F.sum(have).alias(have), F.sum(universe).alias(universe))
    return rows.select(label, have, universe).unionByName(total).withColumn("pct", safe_pct(F.col(have), F.col(universe)))


def roadmap(items: DataFrame) -> DataFrame:
    """By phase: totals, completed, in progress, estimated laws and the titles in order."""
    return items.groupBy("phase").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "in_progress").alias("in_progress"),
        F.sum("estimated_laws").alias("estimated"), F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "title"))), lambda x: x.title).alias("titles"),
    )


def error_summary(errors: DataFrame, last: int = 5) -> tuple[DataFrame, DataFrame]:
    """Counts by category, law and stage, blank ones left out; and the last errors."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("category", "law_id", "stage")])
    counts = errors.select(F.inline(kinds)).where("coalesce(key, '') <> ''").groupBy("kind", "key").agg(F.count("*").alias("n"))
    return counts, errors.orderBy(F.col("at").desc_nulls_last()).limit(last)


def quality_summary(rows: DataFrame, overall: str) -> DataFrame:
    """Grades and mean score."""
    return rows.groupBy(grade(F.col(overall)).alias("grade")).agg(F.count("*").alias("n"), F.bround(F.avg(overall), 1).alias("mean"))


def benchmark_summary(rows: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Documents (found, expected, confidence, ms): pass rate, mean deviation, confidence and time."""
    delta = F.abs(F.col("found") - F.col("expected")) / F.col("expected")
    return rows.agg(F.count("*").alias("n"), F.avg((delta <= tolerance).cast("int")).alias("pass_rate"), F.avg(delta * 100).alias("mean_delta_pct"), F.avg("confidence").alias("mean_confidence"), F.avg("ms").alias("mean_ms"))


def phase_status(rows: DataFrame) -> DataFrame:
    """Phases succeeded and failed, and the run's status."""
    out = rows.agg(F.count_if(F.col("ok")).alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("succeeded") > 0, "partial").otherwise("failed"))


def nested_failures(states: DataFrame) -> DataFrame:
    """States (state, failed_laws array<struct<.., error>>): permanent and other failures."""
    bad = F.filter("failed_laws", lambda x: F.lower(x.error).rlike("404|not found"))
    return states.select("state", F.size(bad).alias("permanent"), (F.size("failed_laws") - F.size(bad)).alias("transient"))


def failure_counts(failures: DataFrame, key: str, error: str) -> DataFrame:
    """A25 over a failure a row: counts with partial aggregation, so a key's rows are never gathered."""
    permanent = F.count_if(F.lower(error).rlike("404|not found"))
    return failures.groupBy(key).agg(permanent.cast("int").alias("permanent"), (F.count("*") - permanent).cast("int").alias("transient"))


def gap_states(events: DataFrame, key: str, order: str, action: str) -> DataFrame:
    """N13 over an action a row: what ``rules.gap_after`` gives for a key's actions in order, from tier 0 and open, by partial
    aggregates: the first action that ends a gap, and the escalations before it."""
    at = F.struct(F.col(order).alias("o"), F.col(action).alias("a"))
    rows = events.select(key, at.alias("at"))
    ends = F.when(F.col("at.a").isin("resolve", "permanent"), F.col("at"))
    each = rows.groupBy(key).agg(F.min(ends).alias("end"), F.count_if(F.col("at.a") == "escalate").alias("all"))
    ended = each.where(F.col("end").isNotNull()).select(F.col(key).alias("ended_key"), F.col("end").alias("first_end"))
    early = rows.where("at.a = 'escalate'").join(ended, F.col(key).eqNullSafe(F.col("ended_key"))).where(F.col("at") < F.col("first_end"))
    before = early.groupBy(F.col("ended_key")).agg(F.count("*").alias("before"))
    n = F.when(F.col("end").isNull(), F.col("all")).otherwise(F.coalesce("before", F.lit(0)))
    status = F.when(F.col("end.a") == "resolve", "resolved").when(F.col("end.a") == "permanent", "permanent").when(n == 0, "open").when(n <= 4, "in_progress").otherwise("blocked")
    return each.join(before, F.col(key).eqNullSafe(F.col("ended_key")), "left").select(key, F.least(n, F.lit(4)).cast("int").alias("tier"), status.alias("status"))


def acquisition(log: DataFrame) -> DataFrame:
    """A26."""
    return log.withColumn("success_rate", F.coalesce(F.bround(F.try_divide(F.col("downloaded") * 100, F.col("found")), 1), F.lit(0.0))).withColumn(
        "duration_seconds", F.unix_seconds(F.col("finished_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")))


def treaty_summary(rows: DataFrame) -> DataFrame:
    """A27."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("bilateral", "multilateral")], F.count_if(F.col("detail").isNotNull()).alias("with_details"), F.count_if(F.col("detail").isNull()).alias("missing_details"))


def composite(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row of several one-row aggregates; each is a single row by construction."""
    out = None
    for name, df in parts.items():
        row = df.select(F.struct(*df.columns).alias(name))
        out = row if out is None else out.crossJoin(F.broadcast(row))
    return out


def by_state(db: DataFrame, scraped: DataFrame, probed: DataFrame) -> DataFrame:
    """(state, n) of three sources, zeros where one has none."""
    frames = [d.select("state", F.col("n").alias(k)) for k, d in (("in_db", db), ("scraped", scraped), ("probed", probed))]
    joined = frames[0].join(frames[1], "state", "full_outer").join(frames[2], "state", "full_outer")
    return joined.na.fill(0, ["in_db", "scraped", "probed"])


def deviation(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """More than half off is FAIL, more than a tenth WARN."""
    off = F.abs(F.col("found") - F.col("expected")) / F.col("expected")
    return expected.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).withColumn("verdict", F.when(off > 0.5, "FAIL").when(off > 0.1, "WARN").otherwise("OK"))


#: A name's length from which it is near its limit, and most characters of a text in the index.
NAME_NEAR, TEXT_MAX = 490, 50_000


def data_quality(
    laws: DataFrame, id_: str, *, name: Column, path: Column, text: Column, indexed: Column, samples: Column,
    references: Column, targets: Column, resolved: Column, published: Column, sentinel: Column,
) -> DataFrame:
    """(id, check, verdict) of nine checks. ``text`` is what the path gives, null if nothing; ``indexed`` is the number of articles in the
    index, null without one, and ``samples`` a few of their texts; ``references``, ``targets`` and ``resolved`` count a law's references, the
    laws that they name and those of them that there are."""
    articles = akn_article_count(F.when(content_type(text) == "akn", text))  # only documents that are XML are parsed
    no_text, bad = text.isNull(), F.exists(samples, lambda x: F.coalesce(x, F.lit("")).rlike("^$|\ufffd\\s*$"))
    checks = {
        "field_lengths": F.when(F.length(name) >= NAME_NEAR, "warning").otherwise("pass"),
        "file_existence": F.when(path.isNull(), "skip").when(no_text, "fail").otherwise("pass"),
        "text_size": F.when(no_text, "skip").when(F.length(text) > TEXT_MAX, "warning").otherwise("pass"),
        "akn_article_count": F.when(no_text | (content_type(text) != "akn"), "skip").when(articles < 0, "warning").otherwise("pass"),
        "encoding_check": F.when(no_text, "skip").when(F.contains(text, F.lit("\ufffd")), "warning").otherwise("pass"),
        "db_es_article_count": F.when(indexed.isNull(), "skip").when((indexed == 0) & path.isNotNull(), "warning").otherwise("pass"),
        "es_text_sample": F.when(F.coalesce(F.size(samples), F.lit(0)) <= 0, "skip").when(bad, "warning").otherwise("pass"),
        "xref_slug_match": F.when(references == 0, "skip").when(resolved < targets, "warning").otherwise("pass"),
        "date_sentinel": F.when(published.isNull(), "skip").when(published == sentinel, "warning").otherwise("pass"),
    }
    return laws.select(F.col(id_), F.inline(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("verdict")) for k, v in checks.items()])))
