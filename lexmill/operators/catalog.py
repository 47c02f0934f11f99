"""Listing, filters, facets and counts over a catalogue of laws."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import icontains

#: Consumer domains and their categories.
DOMAINS = {
    "finance": ("fiscal", "mercantil"), "criminal": ("penal",), "labor": ("laboral",), "civil": ("civil",), "administrative": ("administrativo",),
    "constitutional": ("constitucional",), "manufacturing": ("laboral", "administrativo", "mercantil"), "commerce": ("mercantil", "fiscal", "administrativo"),
    "foreign_trade": ("fiscal", "mercantil", "administrativo"), "financial_services": ("fiscal", "mercantil"), "professional_services": ("civil", "administrativo", "laboral"),
}


def given(value: str | None) -> bool:
    """An empty parameter or ``all`` is no filter."""
    return value not in (None, "", "all")


def one_or_many(c: Column, value: str) -> Column:
    """one value compares without case, a comma list exactly."""
    values = [v.strip() for v in value.split(",") if v.strip()]
    return F.lower(c) == values[0].lower() if len(values) == 1 else c.isin(values)


def law_filter(laws: DataFrame, *, tier: str | None = None, status: str | None = None, law_type: str | None = None, category: str | None = None, state: str | None = None, text: str | None = None) -> DataFrame:
    """The filters of the law list; all of them reach the scan."""
    for name, value in (("tier", tier), ("status", status), ("law_type", law_type)):
        if given(value):
            laws = laws.where(F.col(name) == value)
    for name, value in (("category", category), ("state", state)):
        if given(value):
            laws = laws.where(one_or_many(F.col(name), value))
    return laws.where(icontains(F.col("name"), text)) if given(text) else laws


def domain_filter(rows: DataFrame, domain: str | None, category: str = "category", domains: Mapping[str, Sequence[str]] = DOMAINS) -> DataFrame:
    """an unknown domain is ignored."""
    return rows.where(F.col(category).isin(*domains[domain])) if domain in domains else rows


def jurisdiction_filter(rows: DataFrame, tokens: Iterable[str], known: Sequence[str] = ("federal", "state", "municipal")) -> DataFrame:
    """any of the known tokens; none known is no filter."""
    wanted = [t for t in tokens if t in known]
    return rows.where(F.col("tier").isin(wanted)) if wanted else rows


def state_prefix(rows: DataFrame, state: str, column: str = "law_id") -> DataFrame:
    """ids that begin with the state's slug."""
    return rows.where(F.startswith(F.col(column), F.lit(f"{state.lower().replace(' ', '_')}_")))


def date_range(c: Column, macro: str, as_of: date) -> Column:
    """F8: this_year, last_year, last_5_years, older; relative to a given day."""
    y = as_of.year
    start = lambda n: F.lit(date(n, 1, 1))
    return {
        "this_year": c >= start(y), "last_year": (c >= start(y - 1)) & (c < start(y)), "last_5_years": c >= start(y - 5), "older": c < start(y - 5),
    }.get(macro, F.lit(True))


def structure_match(c: Column, wanted: str) -> Column:
    """one of the analysed words of ``wanted`` occurs."""
    words = [w for w in wanted.lower().split() if w]
    return F.arrays_overlap(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, words)))


def existing(rows: DataFrame, ids: Sequence, column: str, cap: int = 20) -> DataFrame:
    """which of at most ``cap`` ids there are."""
    return rows.where(F.col(column).isin(list(ids)[:cap])).select(column).distinct()


def stale(sources: DataFrame, cutoff, seen: str = "last_verified", url: str = "source_url") -> DataFrame:
    """F12."""
    return sources.where((F.col(seen).isNull() | (F.col(seen) < F.lit(cutoff))) & (F.coalesce(F.col(url), F.lit("")) != ""))


def actionable_gaps(gaps: DataFrame, level: str | None = None, max_tier: int | None = None) -> DataFrame:
    """F13."""
    gaps = gaps.where(F.col("status").isin("open", "in_progress"))
    gaps = gaps.where(F.col("level") == level) if level else gaps
    gaps = gaps.where(F.col("current_tier") <= max_tier) if max_tier is not None else gaps
    return gaps.orderBy("priority", "current_tier", "state")


def entitled(rows: DataFrame, allowed: Sequence[str], category: str = "category", domains: Mapping[str, Sequence[str]] = DOMAINS) -> DataFrame:
    """rows of the categories that a key's domains allow, as a predicate that reaches the scan. A key without domains sees all; one
    with unknown domains only, nothing."""
    return rows.where(F.col(category).isin(sorted({c for d in allowed for c in domains.get(d, ())}))) if allowed else rows


def scoped(rows: DataFrame, law: str, without: str | None = "full_text", law_id: str = "law_id", article: str = "article") -> DataFrame:
    """one law's articles, without the document that stands for its whole text."""
    rows = rows.where(F.col(law_id) == law)
    return rows.where(F.col(article) != without) if without else rows


def others(rows: DataFrame, law: str, law_id: str = "law_id") -> DataFrame:
    """all but one law."""
    return rows.where(F.col(law_id) != law)


def link_filter(rows: DataFrame, column: str, include: str, exclude: str) -> DataFrame:
    """keyword patterns to take and to leave."""
    return rows.where(F.col(column).rlike(include) & ~F.col(column).rlike(exclude))


def valid_records(rows: DataFrame, required: Sequence[str], url: str | None = None) -> DataFrame:
    """F16: required fields aren't blank, and the url has a scheme and a host."""
    for c in required:
        rows = rows.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    if url:
        rows = rows.where(F.try_parse_url(F.col(url), F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(F.col(url), F.lit("HOST")).isNotNull())
    return rows


def display_name(short: Column, full: Column) -> Column:
    """F17."""
    return F.coalesce(F.nullif(short, F.lit("")), full)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def state_of_id(law_id: Column) -> Column:
    return F.initcap(F.substring_index(law_id, "_", 1))


def within_hours(c: Column, now: Column, hours: int) -> Column:
    """unparsable times drop out."""
    return F.try_to_timestamp(c) >= now - F.make_interval(hours=F.lit(hours))


def detail(parents: DataFrame, children: DataFrame, key: str, value, order: str) -> DataFrame:
    """one parent with its children, latest first."""
    rows = children.where(F.col(key) == value)
    kids = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in rows.columns if c not in (key, order)])), asc=False).alias("children"))
    return parents.where(F.col(key) == value).join(kids, key, "left")


def group_counts(rows: DataFrame, *keys: str, default: Mapping[str, str] | None = None, skip_blank: bool = False) -> DataFrame:
    """Rows by keys; ``default`` replaces nulls."""
    for k, v in (default or {}).items():
        rows = rows.withColumn(k, F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(v)))
    if skip_blank:
        for k in keys:
            rows = rows.where(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def conditional_counts(rows: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Many counts in one pass."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()])


def facets(rows: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """(facet, key, n): each facet's largest values, in one pass over the rows; ties by key."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("key")) for f in sizes])
    counts = rows.select(F.inline(pairs)).where("key is not null").groupBy("facet", "key").agg(F.count("*").alias("n"))
    limit = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "key"))
    return counts.withColumn("r", rank).where(F.col("r") <= F.element_at(limit, F.col("facet"))).drop("r")


def law_list(laws: DataFrame, versions: DataFrame, key: str, order: Sequence[Column], page: int = 1, size: int = 50) -> DataFrame:
    """A page of laws with their numbers of versions. Versions are counted before the join, so it stays one row per law."""
    counts = versions.groupBy(key).agg(F.count("*").alias("n_versions"))
    joined = laws.join(counts, key, "left").withColumn("n_versions", F.coalesce("n_versions", F.lit(0)))
    return joined.orderBy(*order).offset((page - 1) * size).limit(size)


#: Most rows of a search page by tier of the caller.
PAGE_CAPS = {
    "anon": 25, "community": 1000, "essentials": 50, "free": 50, "academic": 100, "pro": 100, "premium": 100,
    "enterprise": 1000, "institutional": 1000, "internal": 1000,
}


def page_of(rows: DataFrame, order: Sequence[Column], page: int = 1, size: int = 10, tier: str = "anon", caps: Mapping[str, int] = PAGE_CAPS) -> DataFrame:
    """A page; its size is at least 1 and at most the tier's cap, that of the least tier for an unknown one."""
    size = min(max(1, size), caps.get(tier, min(caps.values())))
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def keyset_page(rows: DataFrame, keys: Sequence[str], after: Sequence | None, size: int) -> DataFrame:
    """The page after a key; the bound reaches the scan as an ordinary predicate on the first key."""
    if after is not None:
        bound = F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)])
        rows = rows.where((F.col(keys[0]) >= after[0]) & (F.struct(*keys) > bound))
    return rows.orderBy(*keys).limit(size)


def recent(versions: DataFrame, laws: DataFrame, key: str, order: Sequence[Column], n: int = 5) -> DataFrame:
    """The latest n versions with their laws; top n before the join."""
    return F.broadcast(versions.orderBy(*order).limit(n)).join(laws, key)


def with_flag(rows: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether there is a row of ``other``."""
    return rows.join(other.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def coverage(have: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """Have against universe by key, and in percent."""
    from ..functions.rules import safe_pct

    joined = universe.join(have, key, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return joined.withColumn("pct", safe_pct(F.col("have"), F.col("universe")))


def allowed(requests: DataFrame, tiers: DataFrame, key: str, features: str, feature: str) -> DataFrame:
    """Requests with whether their tier has the feature; tiers are a few rows: (key, array of features). An unknown tier has none."""
    table = F.broadcast(tiers.select(key, F.col(features).alias("has")))
    return requests.join(table, key, "left").withColumn("allowed", F.coalesce(F.array_contains("has", F.col(feature)), F.lit(False))).drop("has")
