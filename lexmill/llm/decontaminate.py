"""Benchmark decontamination on DataFrame functions only.

A document word is hit if it lies in an occurrence of an item's window: W consecutive item words, or the whole item if
it has fewer. Scanning all windows of all documents would hash each word W times; instead every window of length m
holds an aligned block of q words of the document whenever m >= q + s - 1, for blocks that start at each s-th word. So
the documents' aligned blocks (one s-th of all positions) are probed in the broadcast hash set of the items' q-grams,
and only windows around blocks that hit are compared, by their whole text. The filter loses nothing.

Windows shorter than W (short items) have block sizes of their own: 9-10 words take q = s = 5, 5-8 take 3, 3-4 take 2,
1-2 take 1. Equal texts are matched once, by digest. Item tables up to ``BROADCAST_BYTES`` are broadcast; larger ones join
by shuffle.

Defined cases: a null or empty text has no words and no hits; null or wordless items are ignored; repeated items with
one id count once; repeated documents give repeated rows; an empty benchmark leaves every document clean; the item ids
of a document sort as strings. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, ascii_lower, bounded, saved

#: What parts words here: every ASCII character but letters and digits.
PART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PART), lambda w: w != "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, m, win, ws): each item's distinct windows, as joined text and as an array of m words."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")
    return (
        w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(window)))).alias("ws"))
        .select("item_id", F.size("ws").alias("m"), F.array_join("ws", " ").alias("win"), "ws")
        .dropDuplicates(["item_id", "win"])
    )


def tier(m: int) -> int:
    """Block length and stride for windows of m words: the largest q with 2 q - 1 <= m, shared by neighbouring m."""
    return (m + 1) // 2 if m >= 9 else 3 if m >= 5 else 2 if m >= 3 else 1


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _grams(ws: str, starts: Column, q: int) -> Column:
    """Hashes of the q words from each start."""
    return F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i + 1, F.lit(q))))


def _blocks(q: int) -> Column:
    """The aligned blocks of q words of ``w``: q, place, hash."""
    cut = F.expr(f"sequence(0, cast(size(w) / {q} as int) - 1)")
    made = F.transform(cut, lambda k: F.struct(F.lit(q).alias("q"), (k * q).alias("p"), F.xxhash64(F.slice("w", k * q + 1, F.lit(q))).alias("h")))
    return F.when(F.expr(f"size(w) >= {q}"), made).otherwise(F.array().cast("array<struct<q:int,p:int,h:bigint>>"))


def _around(m: int, q: int) -> Column:
    """The windows of m words of ``w`` that hold a block in ``near``: place, m, text."""
    at = F.filter("near", lambda x: x.q == q)
    starts = F.array_distinct(F.flatten(F.transform(at, lambda x: F.sequence(F.greatest(x.p - (m - q), F.lit(0)), x.p))))
    starts = F.filter(starts, lambda i: i + m <= F.size("w"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(m).alias("m"), F.array_join(F.slice("w", i + 1, F.lit(m)), " ").alias("win")))


def hits(texts: DataFrame, wins: DataFrame, window: int = WINDOW) -> DataFrame:
    """(digest, pos, m, win) for each occurrence of a window in the distinct texts of ``texts`` (digest, text)."""
    size = wins.agg(F.sum(F.octet_length("win") + 64)).first()[0] or 0
    lengths = sorted(r[0] for r in wins.select("m").distinct().collect())  # at most WINDOW values
    grams: list[DataFrame] = []
    tiers = sorted({tier(m) for m in lengths})
    bag = wins.select("m", "ws")
    for q in tiers:
        ms = [m for m in lengths if tier(m) == q]
        grams.append(
            bag.where(F.col("m").isin(ms))
            .select(F.lit(q).alias("q"), F.explode(_grams("ws", F.expr(f"sequence(0, m - {q})"), q)).alias("h"))
            .distinct()
        )
    if not grams:
        return texts.sparkSession.createDataFrame([], "digest string, pos int, m int, win string")
    keys = grams[0]
    for g in grams[1:]:
        keys = keys.unionByName(g)
    keys = _small(saved(keys, "decon-grams"), size)
    some = [_blocks(q) for q in tiers]
    near = (
        texts.select("digest", words(F.col("text")).alias("w"))
        .select("digest", F.inline(some[0] if len(some) == 1 else F.concat(*some)))
        .join(keys, ["q", "h"], "left_semi")
        .select("digest", "q", "p").distinct()
        .groupBy("digest").agg(F.collect_set(F.struct("q", "p")).alias("near"))  # bounded by the text's own words
    )
    near = saved(near, "decon-near")
    small = F.broadcast(near) if (near.agg(F.sum(F.size("near") * 16 + 64)).first()[0] or 0) <= BROADCAST_BYTES // 4 else near
    found = texts.join(small, "digest").dropDuplicates(["digest"]).select("digest", words(F.col("text")).alias("w"), "near")
    spans = [_around(m, tier(m)) for m in lengths]
    there = _small(wins.select("m", "win").distinct(), size)
    return found.select("digest", F.inline(spans[0] if len(spans) == 1 else F.concat(*spans))).join(there, ["m", "win"], "left_semi")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per distinct text that is hit: digest, spans (sorted array of hit word positions), n_hit, items (sorted ids as strings)."""
    wins = saved(item_windows(items, window), "decon-windows")
    texts = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    found = saved(hits(texts, wins, window), "decon-hits")
    covered = (
        found.groupBy("digest").agg(F.collect_set(F.struct("pos", "m")).alias("at"))
        .select("digest", F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x.pos, x.pos + x.m - 1))))).alias("hit_words"))
    )
    ids = (
        found.select("digest", "win").distinct().join(wins.select("win", "item_id"), "win")
        .groupBy("digest").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    return covered.join(ids, "digest", "left")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = bounded(saved(
        contamination(docs, items, window).select("digest", F.size("hit_words").alias("hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        .select("digest", "hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha")), "decon-found"), 160)
    return (
        docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
        .join(found, "digest", "left")
        .select(
            "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, unchanged; those with null, empty or wordless text stay, and all do without items. docs may have
    any other columns."""
    key = f"hit_{uuid.uuid4().hex}"  # no column of docs has that name
    found = bounded(saved(contamination(docs, items, window).select(F.col("digest").alias(key)), "decon-drop"))
    return docs.join(found, F.md5(F.coalesce("text", F.lit(""))) == F.col(key), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """All documents; in those that are hit, the hit words go and the other words stay, lower-cased, with one space between. docs may have
    any other columns."""
    key, hit = (f"{x}_{uuid.uuid4().hex}" for x in ("digest", "hit"))  # no columns of docs have these names
    found = bounded(saved(contamination(docs, items, window).select(F.col("digest").alias(key), F.col("hit_words").alias(hit)), "decon-spans"), limit=limit, more=F.size(hit) * 4)
    kept = F.array_join(F.filter(F.transform(words(F.col("text")), lambda w, i: F.when(~F.array_contains(hit, i), w)), lambda w: w.isNotNull()), " ")
    out = docs.join(found, F.md5(F.coalesce("text", F.lit(""))) == F.col(key), "left")
    return out.withColumn("text", F.when(F.col(hit).isNull(), F.col("text")).otherwise(kept)).drop(key, hit)


#: DuckDB SQL for ``report``.
REPORT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i + 1 : i + 10], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, i, m, array_to_string(w[i + 1 : i + m], ' ') AS win FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT DISTINCT r, i, m, item_id FROM dw JOIN iw USING (m, win)),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
