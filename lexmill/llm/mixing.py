"""Mixing sources to target weights by weighted fair queueing, on DataFrame functions only.

Each document, in a shuffled order of its source, gets a virtual finish time: the words of its source up to and
with it, over the source's target. All sources then reach time 1 together, each having sent its target, so equal
bins of virtual time hold equal numbers of words whatever the sizes of the sources: the global range sort is
balanced by construction, and a hot source is cut by the shuffle key's leading digits.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order;
repeated rows are separate documents, and rows that agree in id and size are interchangeable; an empty table gives
an empty mix; other columns are ignored. If all sizes are 0, all targets are 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded, saved, word_count

WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """(source, source_size, target): weights cycle over the sources by code point, null last; targets share the sum
    of all sizes and stop at ``repeats`` times the source's size, the excess going to the others by weight.

    The fixed point of that resharing is a water level: sources in order of cap over weight are capped up to the first
    whose cap is above its share of what the capped ones leave. One row per source: the windows are over that table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("double"))
        .withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    )
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double")
    level = table.withColumns({
        "total": total,
        "left": total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    }).withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w"))
    held = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    free = F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0.0)).over(every)
    return level.select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise((F.col("total") - held) * F.col("w") / free).alias("target"),
        F.col("total").cast("long").alias("budget"),
    )


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def queue(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = 3, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, budget, ``served`` (words of its source up to and
    with it in shuffled order, in the first round) and the columns of ``carry``. Saved, since later steps read it more than once."""
    sized = saved(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), seed).alias("key"), *carry), "mix-sizes"
    )
    targets = bounded(saved(source_targets(sized, weights, repeats), "mix-targets"), 128)
    digits = max(2, math.ceil(math.log(max(1, sized.count()) / 20_000, 16))) if sized.take(1) else 2
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    offsets = bounded(saved(
        sized.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("size").alias("n"))
        .select("s", "b", (F.sum("n").over(Window.partitionBy("s").orderBy("b")) - F.col("n")).alias("offset")), "mix-offsets"), 64)
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    return saved(
        sized.withColumn("within", F.sum("size").over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .drop("s", "b")
        .join(targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t")))
        .select("doc_id", "source", "size", "source_size", "target", "budget", (F.col("offset") + F.col("within")).alias("served"), *carry),
        "mix-queue",
    )


def schedule(queued: DataFrame, repeats: int = 3, bins: int = 4096) -> DataFrame:
    """A row for each round in which a document is queued before its source's target: ``finish`` (virtual time),
    ``before`` (words of the whole mix ahead of it) and ``take`` (words taken until the total budget).

    Order of the mix: finish, source, served, round. The prefix sums go over equal bins of virtual time first."""
    copies = (
        queued.where("size > 0 and served - size < target")
        .withColumn("round", F.explode(F.expr(f"sequence(0, cast(least({repeats - 1}, floor((target - served + size) / source_size)) as int))")))
        .withColumn("start", F.col("round") * F.col("source_size") + F.col("served") - F.col("size"))
        .where("start < target")
        .withColumn("finish", (F.col("start") + F.col("size")) / F.col("target"))
        .withColumn("bin", F.least(F.floor(F.col("finish") * bins), F.lit(2 * bins)).cast("int"))
    )
    ahead = F.broadcast(  # at most 2 * bins + 1 rows
        copies.groupBy(F.col("bin").alias("b")).agg(F.sum("size").alias("n"))
        .select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("offset"))
    )
    inside = Window.partitionBy("bin").orderBy("finish", F.col("source").asc_nulls_last(), "served", "round").rowsBetween(Window.unboundedPreceding, 0)
    return (
        copies.withColumn("within", F.sum("size").over(inside))
        .join(ahead, F.col("bin") == F.col("b"))
        .withColumn("before", F.col("offset") + F.col("within") - F.col("size"))
        .withColumn("take", F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("before"))).cast("long"))
        .drop("b", "offset", "within", "start")
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = 3, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken (words the mix takes, repeats counted)."""
    queued = queue(docs, weights, repeats, seed)
    same = ["doc_id", "source", "size", "source_size", "target", "served"]
    taken = schedule(queued, repeats).groupBy(*same).agg(F.sum("take").alias("taken"))
    rest = queued.where("not (size > 0 and served - size < target)").select(*same, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(rest).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself, in order: the documents' own columns, a row for each time that one is taken. The document on
    which the budget ends is kept whole."""
    names = docs.columns
    row = F.md5(F.to_json(F.struct(*names)))  # the schedule is made of narrow rows; documents join it once, by this
    queued = queue(docs.select("doc_id", "source", "text", row.alias("row")), weights, repeats, seed, ["row"])
    mix = saved(schedule(queued, repeats).where("take > 0").select("row", "finish", "source", "served", "round"), "mix-schedule")
    each = docs.select(F.struct(*names).alias("doc"), row.alias("row")).dropDuplicates(["row"])  # rows of one digest are the same
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("served"), F.col("round")]
    return each.join(mix, "row").repartitionByRange(*order).sortWithinPartitions(*order).select("doc.*")


#: DuckDB SQL for ``mixed`` over documents.
MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                      md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap FROM src),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
             (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0) AS left_, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * w_left <= left_ * w AS capped FROM l),
t AS (SELECT source, source_size, total::BIGINT AS budget,
             CASE WHEN capped THEN cap ELSE (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target FROM c),
q AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.budget,
             sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS served
      FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, r * source_size + served - size AS start_ FROM q, range(3) AS x(r) WHERE size > 0 AND r * source_size + served - size < target),
f AS (SELECT *, sum(size) OVER (ORDER BY (start_ + size) / target, source NULLS LAST, served, r ROWS UNBOUNDED PRECEDING) - size AS before_ FROM e),
k AS (SELECT doc_id, source, size, source_size, target, served, sum(greatest(0, least(size, budget - before_)))::BIGINT AS taken FROM f GROUP BY ALL)
SELECT doc_id, size, source_size, target, taken FROM k
UNION ALL SELECT doc_id, size, source_size, target, 0::BIGINT FROM q WHERE NOT (size > 0 AND served - size < target)
"""
