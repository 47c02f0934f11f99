"""URL filters: allow and block entries in a trie over reversed host labels and path segments; the longest match decides.

A rule is (verdict, host, path): it fits its host and all subdomains, for urls whose path starts with its path. Of the rules that fit, the one
of the longest host decides, then of the longest path; of two of one host and path, block. A url without a rule gets ``default``.

The trie goes to the executors if its measured size is bounded; with more rules, urls meet them by equi-joins on host suffixes and whole path
segments, with the same result.

Defined cases: a null url, and one without ``://``, have an empty host and path and get the default; an empty path starts with no rule's ``/``;
userinfo and ports are part of the host, as given; repeated rows are each judged; other columns are ignored by ``judge`` and kept by
``kept_pages``; empty tables give empty results; a rule with an empty host is an error.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, LOWER, UPPER, ascii_lower, saved

#: The rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bytes that a pickled byte of the trie takes as Python objects, at most.
UNPICKLED = 12
FOUND = "rule string, verdict string"


def after_scheme(url: Column) -> Column:
    """What comes after the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


class Trie:
    """Host labels from the last to the first, then path segments. A host node is [children, path node or None]; a path node is
    [children, tails], where tails are the rests of rules within a segment, the longest first: (rest, rule, verdict)."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.top: list = [{}, None]
        for verdict, host, path in rules:
            if not host or verdict not in ("allow", "block"):
                raise ValueError(f"not a rule: {verdict} {host}{path}")
            host, node = host.translate(str.maketrans(UPPER, LOWER)), self.top
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            node[1] = at = node[1] or [{}, []]
            *whole, rest = path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, []])
            at[1] = sorted({(r, n, v) for r, n, v in at[1] if r != rest or v == "block"} | {(rest, host + path, verdict)}, key=lambda x: (-len(x[0]), x[2] != "block"))

    def roots(self, host: str) -> list:
        """Path nodes of the host and the domains above it, the longest first."""
        node, out = self.top, []
        for label in reversed(host.split(".")):
            if (node := node[0].get(label)) is None:
                break
            if node[1]:
                out.append(node[1])
        return out[::-1]

    @staticmethod
    def longest(at: list, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest prefix of a path below a node."""
        best, start = None, 0
        while at is not None:
            best = next(((n, v) for r, n, v in at[1] if path.startswith(r, start)), best)
            end = path.find("/", start)
            if end < 0 or not at[0]:
                break
            at, start = at[0].get(path[start:end]), end + 1
        return best

    def find(self, roots: list, path: str) -> tuple[str, str] | None:
        return next((hit for at in roots if (hit := self.longest(at, path))), None)


def _lookup(spark: SparkSession, trie: Trie, default: str):
    """A column function (host, path) to {rule, verdict}; each host is walked once a batch."""
    sent = spark.sparkContext.broadcast(trie)

    @F.pandas_udf(FOUND)
    def find(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        tree, known, out = sent.value, {}, []
        for h, p in zip(host, path, strict=True):
            if (roots := known.get(h)) is None:
                roots = known[h] = tree.roots(h)
            out.append(tree.find(roots, p) or (None, default))
        return pd.DataFrame(out, columns=["rule", "verdict"])

    return find


def rule_rows(spark: SparkSession, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Rules as rows (verdict, host, path)."""
    return rules.select("verdict", "host", "path") if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")


def small_trie(rules: Sequence[tuple[str, str, str]] | DataFrame, limit: int) -> Trie | None:
    """The trie, if it takes at most ``limit`` bytes; rows are measured before they are collected."""
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
        if size * UNPICKLED > limit:
            return None
        rules = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]
    trie = Trie(rules)
    return trie if len(pickle.dumps(trie)) * UNPICKLED <= limit else None


def joined(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct rows of ``parts`` (host, path) that a rule fits, by equi-joins: a url is exploded to its host
    suffixes and its prefixes of whole segments, as deep as any rule goes."""
    rules = rules.select("verdict", ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"))
    rules = rules.withColumns({"labels": F.size(F.split("h", r"\.")), "slashes": F.size(F.split("p", "/")) - 1, "head": F.regexp_extract("p", "(?s)^(.*/)?", 0)})
    deep = rules.agg(F.max("labels").alias("labels"), F.max("slashes").alias("slashes"), F.count_if(F.expr("h is null or h = '' or verdict not in ('allow', 'block')")).alias("bad")).first()
    if deep["bad"]:
        raise ValueError(f"{deep['bad']} rules without a host or verdict")
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deep["labels"] or 1))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    heads = F.transform(F.sequence(F.lit(0), F.least(F.size(segments) - 1, F.lit(deep["slashes"] or 0))), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/"))))
    asked = parts.distinct().withColumn("h", F.explode(hosts)).withColumn("head", F.explode(heads))
    fits = asked.join(rules, ["h", "head"]).where(F.startswith("path", "p"))
    order = F.struct("labels", F.length("p").alias("n"), (F.col("verdict") == "block").alias("b"))
    return fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), order).alias("hit")).select("host", "path", "hit.rule", "hit.verdict")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", id_: str = "page_id", url: str = "url", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(id, host, path, rule or null, verdict) of each row."""
    rows = pages.select(F.col(id_), host_of(F.coalesce(url, F.lit(""))).alias("host"), path_of(F.coalesce(url, F.lit(""))).alias("path"))
    trie = small_trie(rules, limit)
    if trie is not None:
        return rows.withColumn("hit", _lookup(pages.sparkSession, trie, default)("host", "path")).select(id_, "host", "path", "hit.rule", "hit.verdict")
    hits = saved(joined(rows.select("host", "path"), rule_rows(pages.sparkSession, rules)), "url-hits")
    return rows.join(hits, ["host", "path"], "left").select(id_, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def kept_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", url: str = "url", limit: int = BROADCAST_BYTES) -> DataFrame:
    """The allowed rows, with their own columns."""
    host, path = host_of(F.coalesce(url, F.lit(""))), path_of(F.coalesce(url, F.lit("")))
    trie = small_trie(rules, limit)
    if trie is not None:
        return pages.where(_lookup(pages.sparkSession, trie, default)(host, path)["verdict"] == "allow")
    whole = pages.select(F.struct(*pages.columns).alias("row"), host.alias("host"), path.alias("path"))
    hits = saved(joined(whole.select("host", "path"), rule_rows(pages.sparkSession, rules)), "url-hits")
    return whole.join(hits, ["host", "path"], "left").where(F.coalesce("verdict", F.lit(default)) == "allow").select("row.*")


#: DuckDB SQL for ``judge`` over pages with ``RULES``.
JUDGE_SQL = r"""
WITH rows_ AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rows_),
rules(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (SELECT i, max_by(h || p, length(h) * 1000 + length(p)) AS rule, max_by(v, length(h) * 1000 + length(p)) AS v
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (i)
"""
