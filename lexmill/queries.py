"""The reference operators bound to the test tables, each with the same query in DuckDB SQL where SQL can say it.

Stand-ins: customer with nation and region for laws, orders for versions, line items between a customer's and a supplier's
nation for citations, events for logs, documents for articles."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import rules, text
from .operators import catalog, dashboards, graph, history, parse, resolve, search, vectors, windows
from .operators.vector_index import VectorIndex
from .plans import sinks
from .plans.folders import folder
from .sources import gazette, readers
from .sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


LAWS = "laws AS (SELECT c_custkey AS official_id, c_name AS name, c_mktsegment AS category, n_name AS state, r_name AS tier, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
REFS = "refs AS (SELECT cn.n_name AS source, sn.n_name AS target, 1 - l_discount AS confidence, l_linenumber AS pos, l_orderkey AS ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"
EDGES = "edges AS (SELECT source, target, count(*) AS weight FROM refs GROUP BY ALL)"
LOG = "log AS (SELECT event_id, ts, user_id, event_type AS query, value AS ms, (props::JSON->>'k')::BIGINT AS results FROM events)"


def laws(s: SparkSession, d: str) -> DataFrame:
    n, r = table(s, d, "nation"), table(s, d, "region")
    places = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("tier")))  # 25 rows
    c = table(s, d, "customer")
    return c.join(places, c.c_nationkey == places.n_nationkey).select(F.col("c_custkey").alias("official_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), "state", "tier", F.col("c_acctbal").alias("bal"))


def versions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_custkey").alias("official_id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("summary"), F.col("o_orderstatus").alias("status"))


def refs(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    li = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount")
    cust = table(s, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey"), F.col("n_name").alias("source"))
    supp = table(s, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("target"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("source", "target", (1 - F.col("l_discount")).alias("confidence"), F.col("l_linenumber").alias("start_position"), F.col("l_orderkey").alias("ok"))
    )


def log(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("query"), F.col("value").alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("results"))


# Catalogue

@query("A5_law_list", f"WITH {LAWS} SELECT official_id, name, category, state, count(o_orderkey) AS n_versions FROM laws LEFT JOIN orders ON o_custkey = official_id WHERE category = 'BUILDING' GROUP BY ALL ORDER BY name, official_id LIMIT 50")
def _(s, d):
    rows = catalog.law_filter(laws(s, d), category="building")
    return catalog.law_list(rows, versions(s, d), "official_id", [F.col("name"), F.col("official_id")]).select("official_id", "name", "category", "state", "n_versions")


@query("F1_filters", f"WITH {LAWS} SELECT official_id, name FROM laws WHERE tier = 'ASIA' AND category IN ('BUILDING', 'MACHINERY') AND name ILIKE '%#00000%'")
def _(s, d):
    return catalog.law_filter(laws(s, d), tier="ASIA", status="all", category="BUILDING, MACHINERY", text="#00000").select("official_id", "name")


@query("F4_iexact_state", f"WITH {LAWS} SELECT official_id FROM laws WHERE lower(state) = 'nation_3'")
def _(s, d):
    return catalog.law_filter(laws(s, d), state="Nation_3").select("official_id")


@query("F5_domain", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
def _(s, d):
    return catalog.domain_filter(table(s, d, "customer", ["c_custkey", "c_mktsegment"]), "homes", "c_mktsegment", {"homes": ("BUILDING", "FURNITURE")})


@query("F6_jurisdiction", f"WITH {LAWS} SELECT official_id, tier FROM laws WHERE tier IN ('ASIA', 'EUROPE')")
def _(s, d):
    return catalog.jurisdiction_filter(laws(s, d), ["ASIA", "EUROPE", "MOON"], ("ASIA", "EUROPE", "AFRICA")).select("official_id", "tier")


@query("F7_state_prefix", "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(replace(p_name, ' ', '_')), 'red_')")
def _(s, d):
    rows = table(s, d, "part", ["p_partkey", "p_name"]).withColumn("k", F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))))
    return catalog.state_prefix(rows, "red", "k").drop("k")


@query("F8_date_range", "SELECT m, count(*) AS n FROM (SELECT unnest([CASE WHEN o_orderdate >= DATE '2001-01-01' THEN 'this_year' END, CASE WHEN o_orderdate >= DATE '2000-01-01' AND o_orderdate < DATE '2001-01-01' THEN 'last_year' END, CASE WHEN o_orderdate >= DATE '1996-01-01' THEN 'last_5_years' END, CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'older' END]) AS m FROM orders) WHERE m IS NOT NULL GROUP BY m")
def _(s, d):
    macros = [F.when(catalog.date_range(F.col("o_orderdate"), m, date(2001, 6, 15)), m) for m in ("this_year", "last_year", "last_5_years", "older")]
    return table(s, d, "orders", ["o_orderdate"]).select(F.explode(F.array(*macros)).alias("m")).where("m is not null").groupBy("m").agg(F.count("*").alias("n"))


@query("F9_structure", "SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['idiot', 'the'])")
def _(s, d):
    return table(s, d, "documents", ["doc_id", "text"]).where(catalog.structure_match(F.col("text"), "Idiot the")).select("doc_id")


@query("F10_exists", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (1, 2, 3, 99999999)")
def _(s, d):
    return catalog.existing(table(s, d, "customer"), [1, 2, 3, 99999999], "c_custkey")


@query("F12_stale", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderpriority <> ''")
def _(s, d):
    return catalog.stale(table(s, d, "orders"), date(1996, 1, 1), "o_orderdate", "o_orderpriority").select("o_orderkey")


@query("F13_actionable", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey % 7 <= 3")
def _(s, d):
    gaps = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("resolved").alias("status"), (F.col("o_orderkey") % 7).alias("current_tier"), F.lit(1).alias("priority"), F.lit("").alias("state"))
    return catalog.actionable_gaps(gaps, max_tier=3).select("o_orderkey", "o_orderstatus")


@query("F14_entitled", "SELECT 'a' AS key, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'AUTOMOBILE') UNION ALL SELECT 'b', count(*) FROM customer UNION ALL SELECT 'c', 0")
def _(s, d):
    domains = {"homes": ("BUILDING", "FURNITURE"), "cars": ("AUTOMOBILE",), "boats": ("SHIP",)}
    rows = table(s, d, "customer", ["c_mktsegment"])
    counts = [catalog.entitled(rows, allowed, "c_mktsegment", domains).agg(F.lit(k).alias("key"), F.count("*").alias("n")) for k, allowed in (("a", ["homes", "cars"]), ("b", []), ("c", ["unknown"]))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("F15_link_filter", "SELECT page_id FROM pages WHERE regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(url, '[?#]')")
def _(s, d):
    return catalog.link_filter(table(s, d, "pages", ["page_id", "url"]), "url", "/(en|fr)/", "[?#]").select("page_id")


@query("F16_valid", "SELECT page_id FROM pages WHERE trim(html) <> '' AND regexp_matches(url, '^[a-z]+://[^/]+')")
def _(s, d):
    return catalog.valid_records(table(s, d, "pages"), ["html"], "url").select("page_id")


@query("F17_projection", f"WITH {LAWS} SELECT official_id, CASE WHEN official_id % 3 = 0 THEN 'short ' || official_id ELSE name END AS display, split_part(name, '#', -1) AS file, 'Art. ' || official_id AS label FROM laws")
def _(s, d):
    short = F.when(F.col("official_id") % 3 == 0, F.concat(F.lit("short "), F.col("official_id").cast("string"))).when(F.col("official_id") % 3 == 1, "")
    return laws(s, d).select("official_id", catalog.display_name(short, F.col("name")).alias("display"), catalog.file_name(F.replace("name", F.lit("#"), F.lit("/"))).alias("file"), F.concat(F.lit("Art. "), F.col("official_id").cast("string")).alias("label"))


@query("F19_detail", "SELECT c_custkey, c_name, count(o_orderkey) AS n_children, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 7 GROUP BY ALL")
def _(s, d):
    rows = catalog.detail(table(s, d, "customer", ["c_custkey", "c_name"]), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey"), "c_custkey", 7, "o_orderdate")
    return rows.select("c_custkey", "c_name", F.greatest(F.size(F.coalesce("children", F.array())), F.lit(0)).cast("long").alias("n_children"), F.get("children", F.lit(0)).o_orderdate.alias("latest"))


@query("F20_listing", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50")
def _(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'F'").where(text.icontains(F.col("o_orderpriority"), "urgent"))
    return o.orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


@query("F21_user_rows", "SELECT event_id, ts FROM events WHERE user_id = 5 ORDER BY ts DESC, event_id LIMIT 100")
def _(s, d):
    return log(s, d).where("user_id = 5").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts")


@query("A1_conditional_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders")
def _(s, d):
    return catalog.conditional_counts(table(s, d, "orders"), {"open": F.col("o_orderstatus") == "O", "done": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT"})


@query("A2_categories", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE coalesce(c_mktsegment, '') <> '' GROUP BY ALL")
def _(s, d):
    return catalog.group_counts(table(s, d, "customer", ["c_mktsegment"]), "c_mktsegment", skip_blank=True)


@query("A3_state_city", f"WITH {LAWS} SELECT state, category, count(*) AS n FROM laws GROUP BY ALL")
def _(s, d):
    return catalog.group_counts(laws(s, d), "state", "category")


@query("A4_states", f"WITH {LAWS} SELECT DISTINCT state FROM laws")
def _(s, d):
    return laws(s, d).select("state").distinct().orderBy("state")


@query("A6_tier_type", f"WITH {LAWS} SELECT concat_ws('_', tier, CASE WHEN bal < 0 THEN 'legislative' ELSE category END) AS k, count(*) AS n FROM laws GROUP BY ALL")
def _(s, d):
    rows = laws(s, d).withColumn("law_type", F.when(F.col("bal") >= 0, F.col("category")))
    return catalog.group_counts(rows, "tier", "law_type", default={"law_type": "legislative"}).select(F.concat_ws("_", "tier", "law_type").alias("k"), "n")


@query("A7_top_categories", "SELECT c_mktsegment, count(c_mktsegment) AS n FROM customer GROUP BY ALL ORDER BY n DESC, c_mktsegment LIMIT 5")
def _(s, d):
    return table(s, d, "customer").groupBy("c_mktsegment").agg(F.count("c_mktsegment").alias("n")).orderBy(F.desc("n"), "c_mktsegment").limit(5)


@query("A8_stats", "SELECT o_orderstatus AS a, o_orderpriority AS b, grouping(o_orderstatus, o_orderpriority)::INT AS gid, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def _(s, d):
    return dashboards.grouping_counts(table(s, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("A12_facets", "WITH c AS (SELECT 'lang' AS facet, lang AS key, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, key) AS r FROM c WHERE key IS NOT NULL) SELECT facet, key, n FROM r WHERE r <= CASE facet WHEN 'lang' THEN 4 ELSE 10 END")
def _(s, d):
    return catalog.facets(table(s, d, "documents", ["lang", "source"]), {"lang": 4, "source": 10})


@query("A16_by_state", f"WITH {LAWS} SELECT state, count(*) AS total, count(*) FILTER (bal < 0) AS negative, count(*) FILTER (bal >= 0) AS other FROM laws GROUP BY state")
def _(s, d):
    return laws(s, d).groupBy("state").agg(F.count("*").alias("total"), F.count_if(F.col("bal") < 0).alias("negative"), F.count_if(F.col("bal") >= 0).alias("other"))


@query("A17_coverage", f"WITH {LAWS}, h AS (SELECT state, count(*) FILTER (category = 'BUILDING') AS have, count(*) AS universe FROM laws GROUP BY state) SELECT state, have, universe, round_even(least(have / universe * 100, 100.0), 1) AS pct FROM h")
def _(s, d):
    rows = laws(s, d)
    have = rows.where("category = 'BUILDING'").groupBy("state").agg(F.count("*").alias("have"))
    return catalog.coverage(have, rows.groupBy("state").agg(F.count("*").alias("universe")), "state").select("state", "have", "universe", "pct")


@query("A17_views", "WITH src AS (SELECT o_orderstatus AS key, count(*) AS n FROM orders GROUP BY ALL) SELECT 'live' AS view, 100000::BIGINT AS universe, sum(n)::BIGINT AS have, round_even(least(sum(n) / 100000.0::DOUBLE * 100, 100.0), 1) AS pct FROM src WHERE key IN ('O', 'P')")
def _(s, d):
    views = s.createDataFrame([("live", 100000, [("O", "n"), ("P", "n")])], "view string, universe long, components array<struct<key:string,field:string>>")
    src = table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("key")).agg(F.count("*").alias("n")).withColumn("field", F.lit("n"))
    return dashboards.coverage_views(views, src).select("view", "universe", "have", "pct")


@query("A18_total_row", f"WITH {LAWS}, h AS (SELECT tier, count(*) FILTER (bal > 0) AS have, count(*) AS universe FROM laws GROUP BY tier), t AS (SELECT * FROM h UNION ALL SELECT 'total', sum(have)::BIGINT, sum(universe)::BIGINT FROM h) SELECT *, round_even(least(have / universe * 100, 100.0), 1) AS pct FROM t")
def _(s, d):
    rows = laws(s, d).groupBy("tier").agg(F.count_if(F.col("bal") > 0).alias("have"), F.count("*").alias("universe"))
    return dashboards.with_total(rows, "tier", "have", "universe")


@query("A28_latest", "SELECT max(o_orderdate) AS latest FROM orders")
def _(s, d):
    return table(s, d, "orders").agg(F.max("o_orderdate").alias("latest"))


@query("A29_page_total", "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20")
def _(s, d):
    rows = table(s, d, "orders", ["o_orderkey", "o_orderstatus"]).where("o_orderstatus = 'P'")
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row; the page needs no window over all rows
    return rows.orderBy("o_orderkey").limit(20).crossJoin(total).select("o_orderkey", "total")


@query("A30_unread", f"WITH {LOG} SELECT count(*) AS total, count(*) FILTER (results % 2 = 0) AS unread FROM log")
def _(s, d):
    return catalog.conditional_counts(log(s, d), {"unread": F.col("results") % 2 == 0})


@query("J1_recent", f"WITH {LAWS}, r AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5) SELECT official_id, name, o_orderkey AS version FROM r JOIN laws ON o_custkey = official_id")
def _(s, d):
    return catalog.recent(versions(s, d), laws(s, d), "official_id", [F.desc("at"), F.col("version")]).select("official_id", "name", "version")


@query("J5_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def _(s, d):
    return catalog.with_flag(table(s, d, "customer", ["c_custkey"]), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "has_orders")


@query("W8_sort", f"WITH {LAWS}, v AS (SELECT o_custkey, count(*) AS n_versions, max(o_orderdate) AS latest FROM orders GROUP BY 1) SELECT official_id, n_versions, latest FROM laws JOIN v ON o_custkey = official_id ORDER BY latest DESC, official_id LIMIT 30")
def _(s, d):
    v = versions(s, d).groupBy("official_id").agg(F.count("*").alias("n_versions"), F.max("at").alias("latest"))
    return laws(s, d).join(v, "official_id").orderBy(F.col("latest").desc_nulls_last(), "official_id").limit(30).select("official_id", "n_versions", "latest")


@query("W9_offset", f"WITH {LAWS} SELECT official_id FROM laws ORDER BY name, official_id LIMIT 25 OFFSET 50")
def _(s, d):
    return laws(s, d).orderBy("name", "official_id").offset(50).limit(25).select("official_id")


@query("W10_keyset", "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (10, 500) ORDER BY o_custkey, o_orderkey LIMIT 100")
def _(s, d):
    return catalog.keyset_page(table(s, d, "orders", ["o_custkey", "o_orderkey"]), ["o_custkey", "o_orderkey"], (10, 500), 100)


# History

@query("W1_changelog", 'WITH v AS (SELECT o_custkey AS official_id, o_orderkey AS version, o_orderdate AS "at", lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_at FROM orders), l AS (SELECT * FROM v ORDER BY "at" DESC, version DESC LIMIT 500) SELECT official_id, version, "at", previous_at FROM l QUALIFY row_number() OVER (PARTITION BY official_id ORDER BY "at" DESC, version DESC) = 1')
def _(s, d):
    return history.changelog(versions(s, d).select("official_id", "version", "at"), "official_id", "at", "version")


@query("W2_first_wins", "SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source")
def _(s, d):
    return history.first_wins(table(s, d, "documents", ["doc_id", "source"]), ["source"], [F.col("doc_id")]).select("doc_id", "source")


@query("W3_backfill", "WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders) SELECT o_custkey, arg_min(p, o_orderkey) FILTER (trim(p) <> '') AS p, arg_min(st, o_orderkey) FILTER (st IS NOT NULL) AS st FROM o GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("p"), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderstatus")).alias("st"))
    return history.back_fill(o, "o_custkey", [F.col("o_orderkey")], ["p", "st"])


@query("W4_gaps", "WITH n AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), g AS (SELECT *, lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS gap_from FROM n) SELECT l_suppkey, gap_from, l_partkey AS gap_to FROM g WHERE l_partkey - gap_from > 5")
def _(s, d):
    return history.gaps(table(s, d, "lineitem", ["l_suppkey", "l_partkey"]), "l_suppkey", "l_partkey", 5)


@query("W7_natural_sort", "SELECT p_partkey, p_name, array_to_string(list_transform(regexp_extract_all(lower(p_name), '(\\d+|\\D+)'), lambda t: CASE WHEN regexp_matches(t, '^\\d') THEN lpad(t, 12, '0') ELSE t END), '') AS k FROM part ORDER BY k, p_partkey LIMIT 50")
def _(s, d):
    return table(s, d, "part", ["p_partkey", "p_name"]).withColumn("k", text.natural_key(F.col("p_name"))).orderBy("k", "p_partkey").limit(50)


@query("W12_sample", "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('sample:' || c_custkey), c_custkey) <= 3")
def _(s, d):
    return history.sample_per(table(s, d, "customer", ["c_mktsegment", "c_custkey"]), "c_mktsegment", "c_custkey", 3)


@query("W12_golden", "SELECT p_brand, arg_min(p_name, (-length(p_name), p_name)) AS p_name FROM part GROUP BY p_brand")
def _(s, d):
    return history.golden(table(s, d, "part", ["p_brand", "p_name"]), "p_brand", "p_name")


@query("W13_recent_list", "SELECT user_id, list(DISTINCT event_type ORDER BY event_type)::VARCHAR AS x FROM events GROUP BY user_id")
def _(s, d):
    rows = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("a"))
    moved = rows.select("user_id", history.most_recent(F.col("a"), F.get("a", F.lit(0))).alias("a"))
    return moved.select("user_id", F.concat(F.lit("["), F.array_join("a", ", "), F.lit("]")).alias("x"))


@query("W14_trailing_hour", "WITH c AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS e, floor(epoch(ts))::BIGINT AS sec FROM events), t AS (SELECT user_id, event_id, sec, count(*) OVER w AS n, min(sec) OVER w AS oldest FROM c WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, n AS n_trailing, CASE WHEN n >= 3 THEN oldest + 86400 - sec END AS retry_after FROM t")
def _(s, d):
    return history.trailing_count(table(s, d, "events"), "user_id", "ts", "event_id", 86400, 3)


@query("W15_fixed_windows", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, greatest(count(*) - 2, 0) AS over FROM events GROUP BY ALL")
def _(s, d):
    return history.fixed_windows(table(s, d, "events"), "user_id", "ts", "1 day", 2)


@query("W15_anchored", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r,
  CASE WHEN user_id % 10 = 0 THEN 1 ELSE 2 END AS m, CASE WHEN user_id % 10 = 1 THEN 3 ELSE 8 END AS h FROM events),
f AS (SELECT user_id, event_id, t, r, t AS mo, 1 AS mn, t AS ho, 1 AS hn, true AS ok, m, h, true AS mok FROM e WHERE r = 1
 UNION ALL SELECT user_id, event_id, t, r, mo, mn, CASE WHEN NOT mok THEN ho0 WHEN ho0 IS NULL OR t >= ho0 + 604800000000 THEN t ELSE ho0 END,
   CASE WHEN NOT mok THEN hn0 WHEN ho0 IS NULL OR t >= ho0 + 604800000000 THEN 1 ELSE hn0 + 1 END,
   mok AND (ho0 IS NULL OR t >= ho0 + 604800000000 OR hn0 + 1 <= h), m, h, mok
 FROM (SELECT e.*, CASE WHEN e.t >= f.mo + 86400000000 THEN e.t ELSE f.mo END AS mo, CASE WHEN e.t >= f.mo + 86400000000 THEN 1 ELSE f.mn + 1 END AS mn, f.ho AS ho0, f.hn AS hn0,
         (e.t >= f.mo + 86400000000 OR f.mn + 1 <= e.m) AS mok FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1))
SELECT user_id, event_id, ok AS allowed, CASE WHEN NOT mok THEN 'minute' WHEN NOT ok THEN 'hour' END AS refused_by,
  CASE WHEN NOT mok THEN ceil((mo + 86400000000 - t) / 1e6) WHEN NOT ok THEN ceil((ho + 604800000000 - t) / 1e6) END::BIGINT AS wait FROM f""")
def _(s, d):
    """Counters that live a day and a week, as events are days apart; users whose number ends in 0 or 1 have limits of their own."""
    users = table(s, d, "events").select("user_id").distinct()
    own = users.select(F.col("user_id").alias("key"), F.when(F.col("user_id") % 10 == 0, 1).alias("per_minute"), F.when(F.col("user_id") % 10 == 1, 3).alias("per_hour"))
    return windows.rate_limited(table(s, d, "events"), "user_id", "ts", "event_id", 2, 8, own, 86_400, 604_800)


@query("W16_unread_first", f"WITH {LOG} SELECT event_id, results % 2 AS seen FROM log ORDER BY seen, ts DESC, event_id LIMIT 40")
def _(s, d):
    rows = log(s, d).select("event_id", (F.col("results") % 2).alias("seen"), "ts")
    return history.unread_first(rows, "seen", "ts").orderBy("seen", F.desc("ts"), "event_id").limit(40).select("event_id", "seen")


@query("W17_latest_of", "SELECT event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type")
def _(s, d):
    return history.latest_of(table(s, d, "events", ["event_type", "ts", "event_id"]), "event_type", "ts", "event_id")


# Analytics

@query("A9_top_queries", f"WITH {LOG} SELECT query, count(*) AS n, round_even(avg(results), 1) AS avg_results FROM log GROUP BY query ORDER BY n DESC, query LIMIT 20")
def _(s, d):
    return dashboards.top_queries(log(s, d), "query", "results")


@query("A9_zero_result", f"WITH {LOG} SELECT query, count(*) AS n, round_even(avg(results), 1) AS avg_results FROM log WHERE results = 0 GROUP BY query ORDER BY n DESC, query LIMIT 20")
def _(s, d):
    return dashboards.top_queries(log(s, d), "query", "results", zero_only=True)


@query("A9_volume_by_day", f"WITH {LOG} SELECT ts::DATE AS day, count(*) AS n, round_even(avg(ms), 0) AS avg_ms FROM log GROUP BY 1")
def _(s, d):
    return dashboards.volume_by_day(log(s, d), "ts", "ms")


@query("A14_gap_dashboard", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS actionable, count(*) FILTER (o_orderstatus = 'F') AS resolved, count(*) FILTER (o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1997-01-01') AS overdue FROM orders")
def _(s, d):
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("resolved")
    return dashboards.gap_dashboard(table(s, d, "orders").select(status.alias("status"), F.col("o_orderdate").alias("next_action_date")), F.lit("1997-01-01").cast("timestamp"))


@query("A15_health", "SELECT count(*) AS total, count(*) FILTER (s_acctbal > 5000) AS healthy, count(*) FILTER (s_acctbal > 0 AND s_acctbal <= 5000) AS degraded, count(*) FILTER (s_acctbal <= 0) AS down, 0::BIGINT AS unknown, count(*) FILTER (s_suppkey % 5 = 0) AS never_checked FROM supplier")
def _(s, d):
    status = F.when(F.col("s_acctbal") > 5000, "healthy").when(F.col("s_acctbal") > 0, "degraded").otherwise("down")
    return dashboards.health_summary(table(s, d, "supplier").select(status.alias("status"), F.when(F.col("s_suppkey") % 5 != 0, F.lit(1)).alias("last_check")))


@query("A20_roadmap", "SELECT p_brand AS phase, count(*) AS total, count(*) FILTER (p_size > 40) AS completed, count(*) FILTER (p_size BETWEEN 20 AND 40) AS in_progress, sum(p_size)::BIGINT AS estimated FROM part GROUP BY p_brand")
def _(s, d):
    status = F.when(F.col("p_size") > 40, "completed").when(F.col("p_size") >= 20, "in_progress").otherwise("planned")
    rows = table(s, d, "part").select(F.col("p_brand").alias("phase"), status.alias("status"), F.col("p_size").cast("long").alias("estimated_laws"), F.col("p_partkey").alias("sort_order"), F.col("p_name").alias("title"))
    return dashboards.roadmap(rows).drop("titles")


@query("A21_errors", "WITH k AS (SELECT unnest([{'kind': 'category', 'key': event_type}, {'kind': 'law_id', 'key': CASE WHEN user_id < 5 THEN user_id::VARCHAR END}, {'kind': 'stage', 'key': ''}], recursive := true) FROM events) SELECT kind, key, count(*) AS n FROM k WHERE coalesce(key, '') <> '' GROUP BY ALL")
def _(s, d):
    rows = table(s, d, "events").select(F.col("event_type").alias("category"), F.when(F.col("user_id") < 5, F.col("user_id").cast("string")).alias("law_id"), F.lit("").alias("stage"), F.col("ts").alias("at"))
    return dashboards.error_summary(rows)[0]


@query("A22_grades", "SELECT CASE WHEN l_quantity * 2 >= 95 THEN 'A' WHEN l_quantity * 2 >= 90 THEN 'B' WHEN l_quantity * 2 >= 80 THEN 'C' WHEN l_quantity * 2 >= 70 THEN 'D' ELSE 'F' END AS grade, count(*) AS n, round_even(avg(l_quantity * 2), 1) AS mean FROM lineitem GROUP BY 1")
def _(s, d):
    return dashboards.quality_summary(table(s, d, "lineitem", ["l_quantity"]).select((F.col("l_quantity") * 2).alias("q")), "q")


@query("A23_benchmark", "WITH b AS (SELECT l_quantity AS f, 25.0 AS e, l_discount AS c, l_tax AS ms FROM lineitem) SELECT count(*) AS n, round(avg(CASE WHEN abs(f - e) / e <= 0.05 THEN 1 ELSE 0 END), 6) AS pass_rate, round(avg(abs(f - e) / e * 100), 6) AS mean_delta_pct, round(avg(c), 6) AS mean_confidence, round(avg(ms), 6) AS mean_ms FROM b")
def _(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_quantity").alias("found"), F.lit(25.0).alias("expected"), F.col("l_discount").alias("confidence"), F.col("l_tax").alias("ms"))
    return dashboards.benchmark_summary(rows).select("n", *[F.round(c, 6).alias(c) for c in ("pass_rate", "mean_delta_pct", "mean_confidence", "mean_ms")])


@query("A24_phases", "SELECT count(*) FILTER (o_orderstatus <> 'P') AS succeeded, count(*) FILTER (o_orderstatus = 'P') AS failed, 'partial' AS status FROM orders")
def _(s, d):
    return dashboards.phase_status(table(s, d, "orders").select((F.col("o_orderstatus") != "P").alias("ok")))


@query("A25_nested", "SELECT user_id::VARCHAR AS state, count(*) FILTER (event_type = 'click')::INT AS permanent, count(*) FILTER (event_type <> 'click')::INT AS transient FROM events GROUP BY user_id")
def _(s, d):
    e = F.when(F.col("event_type") == "click", "HTTP 404").otherwise("timeout")
    return dashboards.failure_counts(table(s, d, "events").select(F.col("user_id").cast("string").alias("state"), e.alias("error")), "state", "error")


@query("A26_acquisition", "SELECT l_orderkey, l_linenumber, coalesce(round_even(CASE WHEN l_quantity <> 0 THEN l_linenumber * 100 / l_quantity END, 1), 0) AS success_rate FROM lineitem")
def _(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("found"), F.col("l_linenumber").alias("downloaded"), F.col("l_shipdate").alias("started_at"), F.col("l_shipdate").alias("finished_at"))
    return dashboards.acquisition(rows).select("l_orderkey", "l_linenumber", "success_rate")


@query("A27_treaties", "SELECT count(*) AS total, count(*) FILTER (p_size < 10) AS bilateral, count(*) FILTER (p_size >= 10) AS multilateral, count(*) FILTER (p_size > 25) AS with_details, count(*) FILTER (p_size <= 25) AS missing_details FROM part")
def _(s, d):
    return dashboards.treaty_summary(table(s, d, "part").select(F.when(F.col("p_size") < 10, "bilateral").otherwise("multilateral").alias("kind"), F.when(F.col("p_size") > 25, F.lit(1)).alias("detail")))


@query("A31_composite", "SELECT (SELECT count(*) FROM customer) AS laws, (SELECT count(*) FROM orders) AS versions, (SELECT count(*) FROM events) AS requests")
def _(s, d):
    parts = {k: table(s, d, t).agg(F.count("*").alias("n")) for k, t in (("laws", "customer"), ("versions", "orders"), ("requests", "events"))}
    return dashboards.composite(parts).select(*[F.col(f"{k}.n").alias(k) for k in parts])


@query("J10_full_outer", "WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), c AS (SELECT n_nationkey AS k, 1 AS n FROM nation WHERE n_nationkey > 10) SELECT coalesce(a.k, b.k, c.k)::VARCHAR AS state, coalesce(a.n, 0) AS in_db, coalesce(b.n, 0) AS scraped, coalesce(c.n, 0)::BIGINT AS probed FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k")
def _(s, d):
    count = lambda t, c, w: table(s, d, t).where(w).groupBy(F.col(c).cast("string").alias("state")).agg(F.count("*").alias("n"))
    return dashboards.by_state(count("customer", "c_nationkey", "c_nationkey < 15"), count("supplier", "s_nationkey", "true"), count("nation", "n_nationkey", "n_nationkey > 10"))


@query("J12_deviation", "WITH f AS (SELECT o_custkey AS k, count(*) AS found FROM orders GROUP BY 1), e AS (SELECT c_custkey AS k, 10::BIGINT AS expected FROM customer) SELECT k, expected, coalesce(found, 0) AS found, CASE WHEN abs(coalesce(found, 0) - expected) / expected > 0.5 THEN 'FAIL' WHEN abs(coalesce(found, 0) - expected) / expected > 0.1 THEN 'WARN' ELSE 'OK' END AS verdict FROM e LEFT JOIN f USING (k)")
def _(s, d):
    found = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("found"))
    return dashboards.deviation(found, table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(10).cast("long").alias("expected")), "k")



# Graph

@query("A11_edges", f"WITH {REFS} SELECT source, target, count(*) AS weight, round_even(avg(confidence), 8) AS avg_confidence FROM refs WHERE confidence >= 0.95 GROUP BY source, target HAVING count(*) >= 3")
def _(s, d):
    return graph.edges(refs(s, d), 3, 0.95, 8)


@query("A10_top_cited", f"WITH {REFS} SELECT target, count(*) AS n FROM refs GROUP BY target ORDER BY n DESC, target LIMIT 10")
def _(s, d):
    return graph.top_cited(refs(s, d), "target")


@query("G1_ego_d2", f"WITH {REFS}, {EDGES}, c AS (SELECT 'NATION_3' AS slug), w AS (SELECT target AS slug, sum(weight) AS w FROM edges WHERE source = 'NATION_3' AND target <> 'NATION_3' GROUP BY 1 UNION ALL SELECT source, sum(weight) FROM edges WHERE target = 'NATION_3' AND source <> 'NATION_3' GROUP BY 1), n AS (SELECT slug, sum(w) AS w FROM w GROUP BY slug ORDER BY w DESC, slug LIMIT 9) SELECT slug, 0 AS depth FROM c UNION ALL SELECT slug, 1 FROM n")
def _(s, d):
    return graph.ego(graph.edges(refs(s, d)).select("source", "target", "weight"), "NATION_3", 2, "both", 10)


@query("G2_induced", f"WITH {REFS}, {EDGES}, r AS (SELECT 'ASIA' AS x), n AS (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') SELECT source, target, weight FROM edges WHERE source IN (FROM n) AND target IN (FROM n)")
def _(s, d):
    nodes = table(s, d, "nation").join(table(s, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("slug"))
    return graph.induced(graph.edges(refs(s, d)), nodes).select("source", "target", "weight")


@query("G3_overview", f"WITH {REFS}, {EDGES}, h AS (SELECT * FROM edges WHERE weight >= 5), nw AS (SELECT slug, sum(weight) AS w FROM (SELECT source AS slug, weight FROM h UNION ALL SELECT target, weight FROM h) GROUP BY slug ORDER BY w DESC, slug LIMIT 8), i AS (SELECT * FROM h WHERE source IN (SELECT slug FROM nw) AND target IN (SELECT slug FROM nw)) SELECT nw.slug, coalesce(sum(weight), 0)::BIGINT AS ref_count FROM nw LEFT JOIN (SELECT source AS slug, weight FROM i UNION ALL SELECT target, weight FROM i) x ON nw.slug = x.slug GROUP BY nw.slug")
def _(s, d):
    return graph.overview(graph.edges(refs(s, d)), 5, 8)[0]


@query("G4_article_refs", f"WITH {REFS} SELECT source, target, pos AS start_position, count(*) AS n FROM refs WHERE source = 'NATION_3' AND pos = 1 GROUP BY ALL")
def _(s, d):
    rows = refs(s, d).withColumn("source_article", F.col("start_position").cast("string")).withColumn("target_article", F.lit("1"))
    return graph.article_references(rows, "NATION_3", "1")[0].groupBy("source", "target", "start_position").agg(F.count("*").alias("n"))


@query("G5_hierarchy", "WITH p AS (SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT '' AS parent, r_name AS label, 1 AS level FROM p UNION SELECT r_name, n_name, 2 FROM p")
def _(s, d):
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.array("r_name", "n_name").alias("path"))
    return graph.hierarchy(rows, "path")


@query("J4_touching", f"WITH {REFS}, {EDGES} SELECT source, target, weight FROM edges WHERE source IN ('NATION_3', 'NATION_7') OR target IN ('NATION_3', 'NATION_7')")
def _(s, d):
    nodes = s.createDataFrame([("NATION_3",), ("NATION_7",)], "slug string")
    return graph.touching(graph.edges(refs(s, d)), nodes).select("source", "target", "weight")


@query("J3_labels", f"WITH {REFS}, {EDGES}, n AS (SELECT DISTINCT source AS slug FROM edges) SELECT slug, CASE WHEN n_nationkey < 10 THEN 'name of ' || n_name ELSE slug END AS name FROM n JOIN nation ON n_name = slug")
def _(s, d):
    names = table(s, d, "nation").where("n_nationkey < 10").select(F.col("n_name").alias("official_id"), F.concat(F.lit("name of "), F.col("n_name")).alias("name"))
    return graph.labelled(graph.edges(refs(s, d)).select(F.col("source").alias("slug")).distinct(), names)


@query("J6_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def _(s, d):
    r = table(s, d, "orders").select(F.col("o_custkey").alias("source"), F.lit(None).cast("long").alias("target"), "o_orderkey")
    ids = table(s, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("slug"))
    return graph.orphans(r, ids).select("o_orderkey")


@query("J18_batch_refs", f"WITH {REFS}, a AS (SELECT unnest(['NATION_3', 'NATION_7', 'NOWHERE']) AS id) SELECT id, (SELECT count(*) FROM refs WHERE source = id) AS outgoing, (SELECT count(*) FROM refs WHERE target = id) AS incoming FROM a")
def _(s, d):
    return graph.batch_references(refs(s, d), ["NATION_3", "NATION_7", "NOWHERE"])


# Search

TOK = "list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'), lambda x: x <> '')"
INDEX = f"d AS (SELECT doc_id, {TOK} AS t FROM documents), st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_dl FROM d), ix AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL)"


@query("R5_snippet", "SELECT doc_id, CASE WHEN strpos(lower(text), 'idiot') > 0 THEN substring(text, greatest(strpos(lower(text), 'idiot') - 100, 1), 200) ELSE left(text, 200) END AS snippet FROM documents")
def _(s, d):
    return table(s, d, "documents", ["doc_id", "text"]).select("doc_id", search.snippet(F.col("text"), "idiot").alias("snippet"))


@query("R8_suggest", "SELECT DISTINCT p_name FROM part WHERE starts_with(lower(p_name), 'red') ORDER BY p_name LIMIT 8")
def _(s, d):
    return search.suggest(table(s, d, "part", ["p_name"]), "p_name", "red")


@query("R11_ilike", "SELECT doc_id FROM documents WHERE text ILIKE '%idiot%' OR source ILIKE '%src1%'")
def _(s, d):
    return table(s, d, "documents", ["doc_id", "text", "source"]).where(text.icontains(F.col("text"), "idiot") | text.icontains(F.col("source"), "src1")).select("doc_id")


@query("R10_cosine_topk", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query_id, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS c FROM embeddings, q WHERE vec_id <> query_id) SELECT query_id, vec_id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, vec_id)::INT AS rank FROM p QUALIFY rank <= 5")
def _(s, d):
    e = table(s, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("R10_inverted_lists", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query_id, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS c FROM embeddings, q WHERE vec_id <> query_id) SELECT query_id, vec_id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, vec_id)::INT AS rank FROM p QUALIFY rank <= 5")
def _(s, d):
    e = table(s, d, "embeddings")
    base = folder(s)
    index = VectorIndex.build(e, "vec_id", "embedding", f"{base}/index")
    found = index.search(e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, f"{base}/search")
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


@query("R9_embedding_input", "SELECT doc_id, sha256(array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:300], ' ')) AS h FROM documents")
def _(s, d):
    return table(s, d, "documents", ["doc_id", "text"]).select("doc_id", F.sha2(vectors.embedding_input(F.col("text")), 256).alias("h"))


@query("D1_word_changes", "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), '\\s+'), lambda x: x <> '') AS b FROM conversations) SELECT conv_id, turn, (SELECT count(DISTINCT x) FROM unnest(a) AS u(x) WHERE NOT list_contains(coalesce(b, []), x))::INT AS n_added FROM w")
def _(s, d):
    c = table(s, d, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.size(vectors.word_changes(F.col("before"), F.col("text")).added).alias("n_added"))


# Resolution and rules

KEY = "array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ('de','del','la','las','los','el','en','y','a','por','para','que','con','al','se','su','una','un','es')), ' ')"


@query("N3_title_key", f"WITH k AS (SELECT doc_id, sha256({KEY.format(c='text')}) AS k FROM documents) SELECT k, count(*) AS n, min(doc_id) AS first_id FROM k GROUP BY k HAVING count(*) > 1")
def _(s, d):
    return resolve.duplicate_groups(table(s, d, "documents", ["doc_id", "text"]), "text", "doc_id")


@query("J7_new_titles", f"WITH d AS (SELECT doc_id, source, {KEY.format(c='text')} AS k FROM documents), k AS (SELECT DISTINCT k FROM d WHERE source IN ('src0', 'src1', 'src2')) SELECT doc_id FROM d WHERE k NOT IN (SELECT k FROM k WHERE k IS NOT NULL) OR k IS NULL")
def _(s, d):
    docs = table(s, d, "documents", ["doc_id", "source", "text"])
    return resolve.new_titles(docs, docs.where("source in ('src0', 'src1', 'src2')"), "text").select("doc_id")


@query("J8_name_slug", "WITH r AS (SELECT DISTINCT p_type AS n FROM part), l AS (SELECT 'small' AS law, 's1' AS slug, 1 AS o UNION ALL SELECT 'economy', 's2', 2), x AS (SELECT n, arg_min(slug, o) AS slug FROM r JOIN l ON contains(lower(n), law) OR contains(law, lower(n)) GROUP BY n) SELECT r.n AS name, slug FROM r LEFT JOIN x USING (n)")
def _(s, d):
    lw = s.createDataFrame([("SMALL", "s1", 1), ("ECONOMY", "s2", 2)], "name string, slug string, ord int")
    return resolve.name_to_slug(table(s, d, "part").select(F.col("p_type").alias("name")).distinct(), lw)


@query("J9_longest_containment", "WITH n AS (SELECT n_name AS nm, n_nationkey AS o FROM nation), t AS (SELECT 'TREATY WITH ' || n_name || ' OF 1999' AS title FROM nation) SELECT title, arg_max(nm, (length(nm), -o)) AS related FROM t LEFT JOIN n ON contains(title, upper(nm)) GROUP BY title")
def _(s, d):
    n = table(s, d, "nation")
    titles = n.select(F.concat(F.lit("TREATY WITH "), F.col("n_name"), F.lit(" OF 1999")).alias("title"))
    return resolve.longest_contained(titles, n, "title", "n_name", "n_nationkey")


_PASSAGES = "n AS (SELECT item_id AS o, array_to_string((string_split(text, ' '))[4:6], ' ') AS nm FROM benchmark)"


@query("J9_passages", f"WITH {_PASSAGES} SELECT doc_id, arg_max(nm, (length(nm), -o)) AS related FROM documents LEFT JOIN n ON contains(upper(text), upper(nm)) GROUP BY doc_id")
def _(s, d):
    """Which benchmark item, by its fourth to sixth words, a document names; documents are whole texts."""
    passages = table(s, d, "benchmark").select(F.col("item_id"), F.array_join(F.slice(F.split("text", " "), 4, 3), " ").alias("name"))
    found = resolve.longest_contained(table(s, d, "documents", ["doc_id", "text"]), passages, "text", "name", "item_id")
    return found.select("doc_id", "related")


@query("J8_mutual", "WITH l AS (SELECT lower(p_name) AS law, p_partkey AS o FROM part), r AS (SELECT DISTINCT x AS n FROM (SELECT unnest([split_part(p_name, ' ', 2), left(p_name, 4), p_name, 'a ' || p_name || ' of ' || p_type, p_type]) AS x FROM part)), e AS (SELECT n, min(o) AS o FROM r JOIN l ON lower(n) = law GROUP BY n), x AS (SELECT n, min(o) AS o FROM r JOIN l ON contains(lower(n), law) OR contains(law, lower(n)) GROUP BY n) SELECT n AS name, coalesce(e.o, x.o)::VARCHAR AS slug FROM r LEFT JOIN e USING (n) LEFT JOIN x USING (n)")
def _(s, d):
    """References that are names, parts of names, and texts around names."""
    part = table(s, d, "part")
    laws_ = part.select(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("slug"), F.col("p_partkey").alias("ord"))
    said = F.array(F.split_part("p_name", F.lit(" "), F.lit(2)), F.left("p_name", F.lit(4)), "p_name", F.concat(F.lit("a "), "p_name", F.lit(" of "), "p_type"), "p_type")
    return resolve.name_to_slug(part.select(F.explode(said).alias("name")).distinct(), laws_)


@query("J13_merge_catalogues", f"WITH a AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0), ka AS (SELECT {KEY.format(c='p_name')} AS k FROM a) SELECT * FROM a UNION ALL SELECT * FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM a) AND {KEY.format(c='p_name')} NOT IN (FROM ka)")
def _(s, d):
    p = table(s, d, "part", ["p_partkey", "p_name"])
    return resolve.merge_by_id_or_title(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0"), "p_partkey", "p_name")


@query("J14_merge_registry", "WITH a AS (SELECT p_partkey AS k, p_type AS was FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS k, p_brand AS now FROM part WHERE p_partkey % 3 = 0) SELECT k AS p_partkey, coalesce(now, was) AS v, CASE WHEN was IS NULL THEN 'added' WHEN now IS NOT NULL AND now <> was THEN 'updated' ELSE 'kept' END AS change FROM a FULL JOIN b USING (k)")
def _(s, d):
    p = table(s, d, "part")
    return resolve.merge_registry(p.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_type").alias("v")), p.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_brand").alias("v")), "p_partkey", "v")


@query("J15_fanout", "WITH s AS (SELECT 1 AS sub, ['click', 'view'] AS ev, []::VARCHAR[] AS f UNION ALL SELECT 2, ['click', 'purchase'], ['1', '2']) SELECT sub, event_type AS event, count(*) AS n FROM events JOIN s ON list_contains(ev, event_type) AND (len(f) = 0 OR list_contains(f, (user_id % 4)::VARCHAR)) GROUP BY ALL")
def _(s, d):
    subs = s.createDataFrame([(1, ["click", "view"], []), (2, ["click", "purchase"], ["1", "2"])], "sub int, events array<string>, domain_filter array<string>")
    ev = table(s, d, "events").select(F.col("event_type").alias("event"), (F.col("user_id") % 4).cast("string").alias("category"))
    return resolve.fan_out(ev, subs).groupBy("sub", "event").agg(F.count("*").alias("n"))


@query("J16_common", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey = 1), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey = 2) SELECT (SELECT count(*) FROM a JOIN b USING (k)) AS matched, (SELECT count(*) FROM a WHERE k NOT IN (FROM b)) AS only_a, (SELECT count(*) FROM b WHERE k NOT IN (FROM a)) AS only_b")
def _(s, d):
    li = table(s, d, "lineitem", ["l_partkey", "l_suppkey"])
    return resolve.common_articles(li.where("l_suppkey = 1"), li.where("l_suppkey = 2"), "l_partkey")


@query("J20_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(s, d):
    urgent = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return resolve.missing(table(s, d, "customer", ["c_custkey"]), urgent, "c_custkey")


@query("S27_union_first", "WITH u AS (SELECT c_nationkey AS k, 'c' AS src FROM customer UNION SELECT s_nationkey, 's' FROM supplier) SELECT k, min(src) AS src FROM u GROUP BY k")
def _(s, d):
    a = table(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("which")).distinct()
    b = table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("which")).distinct()
    return resolve.union_first([a, b], ["k"]).select("k", F.col("which").alias("src"))


@query("P25_change_class", "SELECT p_partkey, CASE WHEN contains(upper(p_type), 'PROMO') THEN 'abrogation' WHEN contains(upper(p_type), 'SMALL') OR contains(upper(p_type), 'LARGE') THEN 'reform' ELSE 'other' END AS c FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", rules.by_keywords(F.upper("p_type"), {"abrogation": ("PROMO",), "reform": ("SMALL", "LARGE")}, "other").alias("c"))


@query("P27_best_category", "WITH s AS (SELECT doc_id, contains(left(t, 5000), ' the ')::INT + contains(left(t, 5000), ' and ')::INT AS a, contains(left(t, 5000), ' der ')::INT + contains(left(t, 5000), ' die ')::INT AS b FROM (SELECT doc_id, strip_accents(lower(text)) AS t FROM documents)) SELECT doc_id, CASE WHEN a > 0 AND a >= b THEN 'English' WHEN b > 0 THEN 'German' ELSE 'Otros' END AS c FROM s")
def _(s, d):
    return table(s, d, "documents").select("doc_id", rules.best_category(F.col("text"), {"English": (" the ", " and "), "German": (" der ", " die ")}).alias("c"))


@query("P26_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'abrogada' WHEN 'P' THEN 'derogada' ELSE 'vigente' END AS status FROM orders")
def _(s, d):
    name = F.concat(F.lit("Ley Núm. 1 "), F.when(F.col("o_orderstatus") == "F", "(ABROGADA)").when(F.col("o_orderstatus") == "P", "derogada").otherwise("del Agua"))
    return table(s, d, "orders").select("o_orderkey", rules.law_status(name).alias("status"))


@query("P24_health", "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'down' WHEN user_id % 10 = 1 THEN 'degraded' WHEN value * 200 > 10000 THEN 'degraded' ELSE 'healthy' END AS h FROM events")
def _(s, d):
    u = F.col("user_id") % 10
    return table(s, d, "events").select("event_id", rules.health(F.when(u == 0, 500).otherwise(200), u != 1, F.col("value") * 200).alias("h"))


@query("P23_error_class", "SELECT event_id, CASE event_type WHEN 'click' THEN 'DOWNLOAD_ERROR' WHEN 'view' THEN 'PARSE_ERROR' ELSE 'UNKNOWN_ERROR' END AS c FROM events")
def _(s, d):
    message = F.when(F.col("event_type") == "click", "HTTP 500").when(F.col("event_type") == "view", "bad XML").otherwise("?")
    return table(s, d, "events").select("event_id", rules.error_class(F.lit("Error"), message, F.lit(None).cast("string")).alias("c"))


@query("P22_quality", "WITH q AS (SELECT l_orderkey, l_linenumber, (least(CASE WHEN l_quantity / 25 > 1.1 THEN 0.95 ELSE l_quantity / 25 END, 1.0) * 0.7 + (1 - l_discount) * 0.3) * 100 AS a FROM lineitem) SELECT CASE WHEN a >= 95 THEN 'A' WHEN a >= 90 THEN 'B' WHEN a >= 80 THEN 'C' WHEN a >= 70 THEN 'D' ELSE 'F' END AS grade, count(*) AS n FROM q GROUP BY 1")
def _(s, d):
    a = rules.accuracy(F.col("l_quantity"), F.lit(25.0), 1 - F.col("l_discount"))
    return table(s, d, "lineitem").select(rules.grade(a).alias("grade")).groupBy("grade").agg(F.count("*").alias("n"))


_brackets = ", ".join(f"({lo}::DECIMAL(18,2), {fx}::DECIMAL(18,2), {rt}::DECIMAL(6,4))" for lo, fx, rt in rules.BRACKETS)


@query("X2_tax", f"WITH b(lo, fx, rt) AS (VALUES {_brackets}), i AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS inc FROM orders), m AS (SELECT o_orderkey, inc, max(lo) AS lo FROM i JOIN b ON inc >= lo GROUP BY ALL) SELECT o_orderkey, (fx + (inc - m.lo) * rt)::DECIMAL(18,4)::DOUBLE AS tax FROM m JOIN b ON m.lo = b.lo")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", rules.tax(F.col("o_totalprice")).cast("double").alias("tax"))


@query("X1_obligation", "SELECT c_custkey, c_acctbal > 0 OR c_nationkey < 5 AS must_pay, (c_acctbal::DECIMAL(18,2) + 10)::DOUBLE AS income FROM customer")
def _(s, d):
    c = table(s, d, "customer")
    return c.select("c_custkey", rules.must_pay(F.col("c_acctbal") > 0, F.col("c_nationkey") < 5).alias("must_pay"), rules.total_income(F.col("c_acctbal").cast("decimal(18,2)"), F.lit(10)).cast("double").alias("income"))


@query("N5_slug", "SELECT p_partkey, substring(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100) AS slug FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", text.slug(F.col("p_type")).alias("slug"))


@query("N6_stable_id", "SELECT p_partkey, 'sp-' || p_brand || '-' || left(sha256(p_brand || ':' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')), 12) AS id FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", text.stable_id("sp", F.col("p_brand"), F.col("p_name")).alias("id"))


@query("N7_collapse", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("h"))


@query("N10_round", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) AS r FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.python_round(F.col("l_quantity") / 4).alias("r"))


@query("N13_gap_states", f"WITH a AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 5 THEN 'resolve' WHEN event_id % 89 = 7 THEN 'permanent' WHEN event_type IN ('click', 'view') THEN 'escalate' ELSE 'wait' END AS a FROM events), t AS (SELECT user_id, min(event_id) AS e, arg_min(a, event_id) AS a FROM a WHERE a IN ('resolve', 'permanent') GROUP BY 1), n AS (SELECT a.user_id, count(*) FILTER (a.a = 'escalate' AND (e IS NULL OR event_id < e)) AS n, any_value(t.a) AS last FROM a LEFT JOIN t USING (user_id) GROUP BY 1) SELECT user_id, least(n, 4)::INT AS tier, CASE WHEN last = 'resolve' THEN 'resolved' WHEN last = 'permanent' THEN 'permanent' WHEN n = 0 THEN 'open' WHEN n <= 4 THEN 'in_progress' ELSE 'blocked' END AS status FROM n")
def _(s, d):
    i = F.col("event_id")
    action = F.when(i % 97 == 5, "resolve").when(i % 89 == 7, "permanent").when(F.col("event_type").isin("click", "view"), "escalate").otherwise("wait")
    return dashboards.gap_states(table(s, d, "events").select("user_id", "event_id", action.alias("a")), "user_id", "event_id", "a")


@query("P29_treaty_kind", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'bilateral' WHEN o_orderstatus = 'F' THEN 'multilateral' ELSE 'unknown' END AS kind FROM orders")
def _(s, d):
    title = F.when(F.col("o_orderstatus") == "O", "Convenio entre México y Perú").when(F.col("o_orderstatus") == "F", "Convención de Viena").otherwise("Otro")
    return table(s, d, "orders").select("o_orderkey", rules.treaty_kind(title).alias("kind"))


@query("P30_agency", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'Salud' WHEN p_size < 20 THEN 'Ambiente' ELSE '' END AS agency FROM part")
def _(s, d):
    number = F.when(F.col("p_size") < 10, "NOM-001-SSA1-2010").when(F.col("p_size") < 20, "NOM-059-SEMARNAT-2010").otherwise("NOM-1")
    return table(s, d, "part").select("p_partkey", rules.agency(number, {"SSA": "Salud", "SEMARNAT": "Ambiente"}).alias("agency"))


@query("P31_subject", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'administrativa' WHEN p_size < 20 THEN 'comun' ELSE 'penal' END AS subject, CASE WHEN p_size < 10 THEN 'jurisprudencia' ELSE 'tesis_aislada' END AS kind FROM part")
def _(s, d):
    raw = F.when(F.col("p_size") < 10, " Administrativo").when(F.col("p_size") < 20, "Común").otherwise("PENAL")
    return table(s, d, "part").select("p_partkey", rules.subject(raw).alias("subject"), rules.thesis_kind(F.when(F.col("p_size") < 10, "Jurisprudencia por reiteración").otherwise("Tesis")).alias("kind"))


@query("P32_municipality", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'San Pedro' END AS m, 2000 + n_nationkey AS y FROM nation")
def _(s, d):
    title = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Ley de Ingresos del Municipio de San Pedro para ").otherwise("Ley de Ingresos "), (F.col("n_nationkey") + 2000).cast("string"))
    return table(s, d, "nation").select("n_nationkey", text.municipality(title).alias("m"), text.fiscal_year(title).alias("y"))


@query("J19_allowed", "SELECT event_id, user_id % 3 = 1 AND event_type = 'click' OR user_id % 3 = 2 AND event_type IN ('click', 'view') AS allowed FROM events")
def _(s, d):
    tiers = s.createDataFrame([(1, ["click"]), (2, ["click", "view"])], "tier long, features array<string>")
    return catalog.allowed(table(s, d, "events").withColumn("tier", F.col("user_id") % 3), tiers, "tier", "features", "event_type").select("event_id", "allowed")


# Sources and sinks

@query("S10_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def _(s, d):
    return readers.hrefs(table(s, d, "pages"), "page_id", "html")


@query("S10_gazette", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">[^<]*</a>', 1)) AS h, unnest(regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1)) AS t, unnest(range(len(regexp_extract_all(html, '<a href="/[^"]*">[^<]*</a>')))) AS n FROM pages)
SELECT page_id, n::INT AS position, trim(t) AS title, 'PRIMERA SECCION' AS section, 'SECRETARIA DE GOBERNACION' AS authority, 'https://g.example/nota_detalle.php?x=' || h AS url, 'headings' AS strategy FROM l WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 0, 'TERCERA SECCION aviso ' || page_id, 'TERCERA SECCION', 'PODER JUDICIAL', 'https://g.example/nota_detalle.php?codigo=' || page_id, 'rows' FROM pages WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 0, 'Segunda sección: ' || page_id, 'QUINTA SECCION', 'AVISOS JUDICIALES', 'https://g.example/nota_to_doc.php?codnota=' || page_id, 'links' FROM pages WHERE page_id % 3 = 2""")
def _(s, d):
    """Pages with the marks of each layout: their own links under headings, a table row, a link with its context above and before it."""
    number = F.col("page_id").cast("string")
    headed = F.replace(F.replace("html", F.lit("<body>"), F.lit("<body><h2>Primera  Sección</h2><h3>SECRETARIA DE GOBERNACION</h3>")), F.lit('<a href="/'), F.lit('<a href="/nota_detalle.php?x='))
    rows = F.concat("html", F.lit('<table><tr><td>PODER JUDICIAL<tr><td>1<td><a href="nota_detalle.php?codigo='), number, F.lit('">TERCERA SECCION aviso '), number, F.lit("</a></table>"))
    links = F.concat("html", F.lit('<div>QUINTA SECCIÓN<p>AVISOS JUDICIALES</p><span><a href="nota_to_doc.php?codnota='), number, F.lit('">Segunda sección: '), number, F.lit("</a></span></div>"))
    pages = table(s, d, "pages", ["page_id", "html"]).select("page_id", F.when(F.col("page_id") % 3 == 0, headed).when(F.col("page_id") % 3 == 1, rows).otherwise(links).alias("html"))
    return gazette.entries(pages, "page_id", "html", "https://g.example")


@query("S10_link_tree")
def _(s, d):
    return readers.html_links(table(s, d, "pages"), "page_id", "html")


@query("S7_clean_text", "SELECT doc_id FROM documents WHERE length(trim(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'))) >= 100")
def _(s, d):
    return readers.clean_texts(table(s, d, "documents", ["doc_id", "text"]), "text").select("doc_id")


@query("S11_canonical", "SELECT p_partkey::VARCHAR AS id, coalesce(nullif(trim(CASE WHEN p_size < 10 THEN ' ' ELSE p_name END), ''), p_type) AS name FROM part")
def _(s, d):
    p = table(s, d, "part").withColumn("nombre", F.when(F.col("p_size") < 10, " ").otherwise(F.col("p_name")))
    return readers.canonical(p, {"id": ["p_partkey"], "name": ["nombre", "titulo", "p_type"]})


@query("S12_registry", "SELECT p_partkey FROM part WHERE p_size = 7")
def _(s, d):
    return readers.registry(table(s, d, "part"), p_size=7).select("p_partkey")


@query("K1_upsert", "WITH n AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0) SELECT k, coalesce(n.v, c.v) AS v FROM c FULL JOIN n USING (k)")
def _(s, d):
    old = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"), "o_orderkey")
    return sinks.upsert(old, new, ["k"], [F.desc("o_orderkey")])


@query("K3_keep_given", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer")
def _(s, d):
    old = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return sinks.upsert(old, old.select("k", F.when(F.col("k") % 3 == 0, "new").otherwise(" ").alias("v")), ["k"], keep_given=True)


@query("K4_replace", "SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_custkey >= 10 UNION ALL SELECT o_custkey, -o_orderkey FROM orders WHERE o_custkey < 10 AND o_orderkey % 2 = 0")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    few = o.where("k < 10")
    return sinks.replace_partitions(o, few.where("v % 2 = 0").select("k", (-F.col("v")).alias("v")), "k", few.select("k"))


@query("K5_article_docs", "WITH l AS (SELECT source AS law_id, arg_min(text, doc_id) AS raw FROM documents GROUP BY source), a AS (SELECT source AS law_id, doc_id::VARCHAR AS article, text FROM documents WHERE source IN ('src1', 'src2', 'src4')) SELECT l.law_id, coalesce(article, 'full_text') AS article, sha256(CASE WHEN article IS NOT NULL THEN text ELSE left(raw, 50000) END) AS h, CASE WHEN l.law_id = 'src1' THEN 'civil' ELSE 'unknown' END AS category FROM l LEFT JOIN a USING (law_id)")
def _(s, d):
    docs = table(s, d, "documents", ["doc_id", "source", "text"])
    lw = docs.groupBy(F.col("source").alias("law_id")).agg(F.min_by("text", "doc_id").alias("raw_text")).select("law_id", "raw_text", F.when(F.col("law_id") == "src1", "civil").otherwise("").alias("category"), *[F.lit("").alias(c) for c in ("status", "law_type")])
    arts = docs.where("source in ('src1', 'src2', 'src4')").select(F.col("source").alias("law_id"), F.col("doc_id").cast("string").alias("article"), "text")
    return sinks.article_documents(lw, arts).select("law_id", "article", F.sha2("text", 256).alias("h"), "category")


@query("K7_dedup_delete", f"WITH {LAWS}, bad AS (SELECT official_id FROM laws WHERE tier NOT IN ('ASIA', 'EUROPE')) SELECT o_orderkey AS version FROM orders WHERE o_custkey NOT IN (FROM bad)")
def _(s, d):
    return sinks.dedup_delete(laws(s, d), versions(s, d), ["ASIA", "EUROPE"])[1].select("version")


@query("K8_export", "SELECT c_custkey, c_name || coalesce('\n\n' || string_agg(o_orderpriority, '\n\n' ORDER BY o_orderkey), '') AS document FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def _(s, d):
    arts = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return sinks.law_text(table(s, d, "customer"), arts, "c_custkey", "c_name", "o_orderkey", "o_orderpriority")


@query("K11_insert_absent", "SELECT c_nationkey AS k, min('old') AS v FROM customer WHERE c_nationkey < 12 GROUP BY 1 UNION ALL SELECT DISTINCT n_nationkey, 'new' FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 12)")
def _(s, d):
    old = table(s, d, "customer").where("c_nationkey < 12").select(F.col("c_nationkey").alias("k"), F.lit("old").alias("v")).distinct()
    return sinks.insert_absent(old, table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit("new").alias("v")), ["k"])


@query("K12_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(s, d):
    return sinks.update_where(table(s, d, "orders", ["o_orderkey", "o_orderstatus"]), F.col("o_orderstatus") == "P", {"o_orderstatus": F.lit("X")})


# Parsing, over conversations as lines of a document

@query("P_lines", "SELECT doc_id, count(*) FILTER (trim(l) <> '') AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS l FROM documents) GROUP BY doc_id")
def _(s, d):
    rows = parse.lines(table(s, d, "documents", ["doc_id", "text"]), "doc_id", "text")
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    return table(s, d, "documents", ["doc_id"]).join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("P8_confidence", "SELECT conv_id, turn, round(greatest(0, least(1, 1.0 - CASE WHEN length(text) < 50 THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(text, '[.;:]') THEN 0 ELSE 0.2 END + CASE WHEN regexp_matches(text, '(?i)(en términos|conforme|de acuerdo|lo dispuesto)') THEN 0.05 ELSE 0 END)), 6)::DOUBLE AS c FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.round(rules.article_confidence(F.col("text")), 6).alias("c"))


@query("P7_derogated", "SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0")
def _(s, d):
    said = F.when(F.col("turn") % 3 == 0, "Se deroga.").otherwise(F.col("text"))
    return table(s, d, "conversations").where(rules.derogated(said)).select("conv_id", "turn")


_HEADS, _TAILS = ("Artículo 5 Bis. ", "ARTÍCULO 7.- ", "Articulo 12 A bis.", "ARTICULO 3. ", "", "  Artículo 9o "), (";\nseguido", " 2020\nsigue", ")\n1. fin", " Á\nñ\nü  dos   espacios ", ".\nOtra", ",\n\nfin", "")
_list = lambda xs: "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in xs) + "]"


@query("P16_clean", rf"""WITH r AS (SELECT conv_id, turn, trim({_list(_HEADS)}[(conv_id + turn) % 6 + 1] || text || {_list(_TAILS)}[(conv_id + 2 * turn) % 7 + 1], ' ' || chr(10)) AS t FROM conversations),
b AS (SELECT conv_id, turn, regexp_replace(t, '^(?:Art[ií]culo|ARTÍCULO)\s+\d+[\p{{L}}\p{{M}}\p{{N}}_\s]*\.\s*', '') AS t FROM r)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)([a-záéíóúñü,;])\n([a-záéíóúñü])', '\1 \2', 'g'), '(?i)([a-záéíóúñü,;])\n([a-záéíóúñü])', '\1 \2', 'g'), ' {{2,}}', ' ', 'g'), ' ' || chr(10)) AS t FROM b""")
def _(s, d):
    """Texts behind article numbers of each form and before line ends of each kind."""
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (F.expr(at) % len(xs) + 1).cast("int"))
    text_ = F.concat(pick(_HEADS, "conv_id + turn"), "text", pick(_TAILS, "conv_id + 2 * turn"))
    return table(s, d, "conversations").select("conv_id", "turn", parse.clean_article_text(text_).alias("t"))


@query("P10_references")
def _(s, d):
    said = F.concat(F.lit("según el artículo "), F.col("doc_id").cast("string"), F.lit(" de la Ley Federal de "), F.col("source"), F.lit(". "), F.col("text"))
    return parse.references(table(s, d, "documents").select("doc_id", said.alias("text")), "doc_id", "text")


@query("P1_articles")
def _(s, d):
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("Artículo "), x.turn.cast("string"), F.lit(". "), x.text)), "\n").alias("text"))
    return parse.articles(c, "conv_id", "text").select("conv_id", "article_id", "content", "line_number", "derogated", "confidence")


@query("P19_parents", "WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'title' ELSE 'article' END AS kind, role || turn AS label FROM conversations) SELECT conv_id, turn AS line_number, last_value(CASE WHEN kind = 'title' THEN label END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS title FROM e")
def _(s, d):
    e = table(s, d, "conversations").select("conv_id", F.col("turn").alias("line_number"), F.when(F.col("turn") % 4 == 0, "title").otherwise("article").alias("kind"), F.concat("role", F.col("turn").cast("string")).alias("label"))
    return parse.parents(e, "conv_id").select("conv_id", "line_number", "title")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import law_queries, rule_queries, search_queries  # noqa: F401  they register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)
