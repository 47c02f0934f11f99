"""The citation graph.

Edges are aggregated once; a walk is at most three joins of a frontier, which a cap on nodes bounds. Where a cap cuts,
order is (weight desc, slug asc)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key


def edges(references: DataFrame, min_weight: int = 1, min_confidence: float = 0.0, places: int = 3) -> DataFrame:
    """(source, target, weight, avg_confidence); the confidence bound is on references."""
    kept = references.where(F.col("confidence") >= min_confidence) if min_confidence else references
    made = kept.where("target is not null").groupBy("source", "target").agg(F.count("*").alias("weight"), F.bround(F.avg("confidence"), places).alias("avg_confidence"))
    return made.where(F.col("weight") >= min_weight)


def node_weights(graph: DataFrame) -> DataFrame:
    """(slug, ref_count): weight of incident edges; a loop counts twice."""
    ends = F.array(F.col("source"), F.col("target"))
    return graph.select(F.explode(ends).alias("slug"), "weight").groupBy("slug").agg(F.sum("weight").alias("ref_count"))


def heaviest_edges(graph: DataFrame) -> DataFrame:
    """One edge of each (source, target): the heaviest."""
    rest = [c for c in graph.columns if c not in ("source", "target")]
    best = F.max_by(F.struct(*rest), F.struct("weight", *[c for c in rest if c != "weight"])).alias("e")
    return graph.groupBy("source", "target").agg(best).select("source", "target", "e.*")


def induced(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("slug")
    return graph.join(n.withColumnRenamed("slug", "source"), "source", "left_semi").join(n.withColumnRenamed("slug", "target"), "target", "left_semi")


def touching(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among the nodes, by two left joins and no nested loop."""
    n = nodes.select("slug").distinct()
    a, b = n.select(F.col("slug").alias("source"), F.lit(True).alias("s")), n.select(F.col("slug").alias("target"), F.lit(True).alias("t"))
    return graph.join(a, "source", "left").join(b, "target", "left").where("s or t").drop("s", "t")


def ego(graph: DataFrame, center: str, depth: int = 2, direction: str = "both", max_nodes: int = 100) -> DataFrame:
    """G1: (slug, depth): nodes within ``depth`` steps. The heaviest of a step are taken while the cap allows; then the walk ends."""
    steps = []
    if direction in ("both", "out"):
        steps.append(graph.select(F.col("source").alias("at"), F.col("target").alias("slug"), "weight"))
    if direction in ("both", "in"):
        steps.append(graph.select(F.col("target").alias("at"), F.col("source").alias("slug"), "weight"))
    walk = (steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])).persist()  # each step reads it; edges are far fewer than references
    seen = graph.sparkSession.createDataFrame([(center, 0)], "slug string, depth int")
    have, front = 1, seen
    for step in range(1, min(depth, 3) + 1):
        new = (
            walk.join(F.broadcast(front.select(F.col("slug").alias("at"))), "at", "left_semi").groupBy("slug").agg(F.sum("weight").alias("w"))
            .join(F.broadcast(seen.select("slug")), "slug", "left_anti").orderBy(F.desc("w"), "slug").limit(max_nodes - have)
        )
        rows = [(r["slug"], step) for r in new.collect()]  # at most max_nodes
        if not rows:
            break
        front = graph.sparkSession.createDataFrame(rows, "slug string, depth int")
        seen, have = seen.unionByName(front), have + len(rows)
        if have >= max_nodes:
            break
    walk.unpersist()
    return seen


def overview(graph: DataFrame, min_weight: int = 5, max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """The heaviest nodes with counts within the picture, and the edges between them."""
    heavy = graph.where(F.col("weight") >= min_weight)
    nodes = node_weights(heavy).orderBy(F.desc("ref_count"), "slug").limit(max_nodes)
    inner = induced(heavy, nodes)
    return nodes.select("slug").join(node_weights(inner), "slug", "left").withColumn("ref_count", F.coalesce("ref_count", F.lit(0))), inner


def labelled(nodes: DataFrame, laws: DataFrame) -> DataFrame:
    """Names of nodes, the slug where there is none."""
    return nodes.join(laws.select(F.col("official_id").alias("slug"), "name"), "slug", "left").withColumn("name", F.coalesce("name", "slug"))


def article_references(references: DataFrame, law: str, article: str) -> tuple[DataFrame, DataFrame]:
    """Outgoing by position, incoming by confidence."""
    out = references.where((F.col("source") == law) & (F.col("source_article") == article)).orderBy("start_position")
    into = references.where((F.col("target") == law) & (F.col("target_article") == article)).orderBy(F.desc("confidence"), "start_position")
    return out, into


def top_cited(references: DataFrame, column: str, n: int = 10) -> DataFrame:
    """A10: null names are left out before the cut, so there are n rows."""
    return references.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def orphans(references: DataFrame, laws: DataFrame) -> DataFrame:
    """References of which an end isn't a law."""
    ids = laws.select("slug").distinct()
    bad_source = references.join(ids.withColumnRenamed("slug", "source"), "source", "left_anti").withColumn("missing", F.lit("source"))
    bad_target = references.where("target is not null").join(ids.withColumnRenamed("slug", "target"), "target", "left_anti").withColumn("missing", F.lit("target"))
    return bad_source.unionByName(bad_target)


def batch_references(references: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Every asked id with its outgoing and incoming references."""
    asked = F.broadcast(references.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)][:200], "id string"))
    out = references.join(asked.withColumnRenamed("id", "source"), "source", "left_semi").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("outgoing"))
    into = references.join(asked.withColumnRenamed("id", "target"), "target", "left_semi").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("incoming"))
    return asked.join(out, "id", "left").join(into, "id", "left").na.fill(0, ["outgoing", "incoming"])


def hierarchy(rows: DataFrame, path: str) -> DataFrame:
    """Distinct (parent, label, level) of breadcrumb arrays, in natural order of labels."""
    steps = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.struct(F.array_join(F.slice(path, 1, i - 1), " / ").alias("parent"), F.element_at(path, i).alias("label"), i.alias("level")))
    return rows.where(F.size(path) > 0).select(F.inline(steps)).distinct().orderBy("level", "parent", natural_key(F.col("label")), "label")


def strongest(graph: DataFrame, n: int) -> DataFrame:
    """The n heaviest edges of each source."""
    return graph.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "target"))).where(F.col("r") <= n).drop("r")
