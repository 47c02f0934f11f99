"""Nearest vectors by inverted lists that are skipped only where the triangle inequality proves them too far.

Vectors are brought to unit length, where the order of cosine similarity is that of distance. Centroids are fitted on a bounded sample; every vector is in the list of its nearest one.
A list is cut into rings by the distance to its centroid, and a ring into pieces of about 2,000 vectors, so a crowded list is many groups. A query's distance to any
vector of a ring is at least the gap between its own distance to the centroid and the ring's. Its nearest rings give k vectors and so a distance that is enough; then
all rings are read that this distance doesn't rule out. The result is the exact one, ties by id.

Queries meet pieces by shuffle on (piece, block of queries): neither goes through the driver. What does are the sample, the centroids and one row for each ring.

Defined cases: null vectors, and those with null, non-finite or only zero components, are near to nothing; vectors are as long as the sample's first, others drop out; repeated
ids are vectors each, and a query leaves out all vectors of its own id; equal similarities (to 12 places) go by id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.folders import stored

#: Vectors that centroids are fitted on, vectors a centroid stands for, most centroids, rounds of fitting.
SAMPLE, EACH, MOST, ROUNDS = 20_000, 100, 256, 8
#: Levels to a unit of distance, vectors of a ring at least (neighbouring levels are one ring), vectors of a piece, queries of a block.
LEVELS, RING, PIECE, BLOCK = 64, 512, 2048, 4096
#: What rounding may move a distance by.
SLACK = 1e-9


def unit(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, u) of vectors that have a direction."""
    v = F.col(vector)
    good = v.isNotNull() & ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.where(good).select(F.col(id_).alias("id"), v.alias("v"), norm.alias("norm")).where("norm > 0").select("id", F.transform("v", lambda x: x.cast("double") / F.col("norm")).alias("u"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1), 0)
    at = d.argmin(axis=1)
    return at, np.sqrt(((x - centroids[at]) ** 2).sum(axis=1))


def drawn(units: DataFrame, sample: int) -> DataFrame:
    """About twice ``sample`` rows of a large table, the first of all in the order of a hash of their ids: a task sends the driver only these, and not ``sample`` rows of its own."""
    n = units.count()
    if n <= 4 * sample:
        return units
    some = units.where(F.xxhash64("id") < int(-(2**63) + 2**64 * (2 * sample / n)))
    return some if some.count() >= sample else units  # an id that repeats may leave too few


def fit(units: DataFrame, sample: int = SAMPLE, most: int = MOST) -> np.ndarray:
    """Centroids of ``sample`` vectors, taken in the order of a hash of their ids."""
    rows = drawn(units, sample).orderBy(F.xxhash64("id"), "id").limit(sample).select("u").collect()
    size = len(rows[0]["u"]) if rows else 0
    x = np.array([r["u"] for r in rows if len(r["u"]) == size], float).reshape(-1, size) if size else np.zeros((0, 0))
    centroids = x[: max(1, min(most, len(x) // EACH))].copy()
    for _ in range(ROUNDS if len(x) else 0):
        at, _ = _nearest(x, centroids)
        for c in np.unique(at):
            centroids[c] = x[at == c].mean(axis=0)
    return centroids


@dataclass
class VectorIndex:
    members: DataFrame  # (list, ring, piece, id, u)
    centroids: np.ndarray
    rings: np.ndarray  # a row for each: list, ring, vectors, least and greatest distance, pieces

    @classmethod
    def build(cls, vectors: DataFrame, id_: str, vector: str, path: str, sample: int = SAMPLE, most: int = MOST) -> VectorIndex:
        units = stored(unit(vectors, id_, vector), f"{path}/units")
        centroids = fit(units, sample, most)
        size, sent = centroids.shape[1], units.sparkSession.sparkContext.broadcast(centroids)
        kind = units.schema["id"].dataType.simpleString()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    at, d = _nearest(_matrix(batch.column("u")), sent.value)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), pa.array(at.astype(np.int32)), pa.array(d)], ["id", "u", "list", "d"])

        placed = stored(units.where(F.size("u") == size).mapInArrow(place, f"id {kind}, u array<double>, list int, d double").withColumn("level", F.floor(F.col("d") * LEVELS).cast("int")), f"{path}/placed")
        levels = placed.groupBy("list", "level").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))  # at most centroids x levels of a distance of 2
        out = Window.partitionBy("list").orderBy("level")
        levels = stored(levels.withColumn("ring", F.floor((F.sum("n").over(out) - F.col("n")) / RING).cast("int")), f"{path}/levels")
        rings = levels.groupBy("list", "ring").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.ceil(F.sum("n") / PIECE).alias("pieces"))
        table = rings.orderBy("list", "ring").collect()
        cut = placed.join(F.broadcast(levels.select("list", "level", "ring")), ["list", "level"]).join(F.broadcast(rings.select("list", "ring", "pieces")), ["list", "ring"]).withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int"))
        members = stored(cut.select("list", "ring", "piece", "id", "u").repartition("list", "ring", "piece").sortWithinPartitions("list", "ring", "piece"), f"{path}/members")
        return cls(members, centroids, np.array([tuple(r) for r in table], float).reshape(-1, 6))

    def _visits(self, queries: DataFrame, k: int, enough: Column | None) -> DataFrame:
        """(id, u, list, ring) of the rings that each query reads: the nearest that hold k + 1 vectors, or all within ``enough`` but those."""
        kind = queries.schema["id"].dataType.simpleString()
        sent, more = queries.sparkSession.sparkContext.broadcast((self.centroids, self.rings)), enough is not None

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, rings = sent.value
            which, sizes = rings[:, 0].astype(int), rings[:, 2]
            for batch in batches:
                for a in range(0, len(batch), 256):
                    part = batch.slice(a, 256)
                    x = _matrix(part.column("u"))
                    d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1), 0))[:, which]
                    bound = np.maximum(np.maximum(d - rings[:, 4], rings[:, 3] - d), 0)
                    order = np.argsort(bound, axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    first = np.zeros(bound.shape, bool)
                    np.put_along_axis(first, order, before < k + 1, axis=1)
                    if more:
                        first = ~first & (bound <= part.column("enough").to_numpy(zero_copy_only=False)[:, None] + SLACK)
                    row, ring = np.nonzero(first)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), part.column("u").take(pa.array(row)), pa.array(rings[ring, 0].astype(np.int32)), pa.array(rings[ring, 1].astype(np.int32)), pa.array(rings[ring, 5].astype(np.int32))], ["id", "u", "list", "ring", "pieces"])

        rows = queries.withColumn("enough", enough) if more else queries
        return rows.mapInArrow(choose, f"id {kind}, u array<double>, list int, ring int, pieces int")

    def _near(self, visits: DataFrame, blocks: int, k: int) -> DataFrame:
        """(query_id, id, similarity): the k best of each piece that a query reads."""
        kind, other = visits.schema["id"].dataType.simpleString(), self.members.schema["id"].dataType.simpleString()
        asked = visits.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        key = ["list", "ring", "piece", "block"]
        wanted = asked.select(*key).distinct().toDF("l", "r", "p", "b")
        there = self.members.join(wanted, (F.col("list") == F.col("l")) & (F.col("ring") == F.col("r")) & (F.col("piece") == F.col("p"))).select("l", "r", "p", "b", F.col("id").alias("there_id"), F.col("u").alias("there_u"))

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            q, v = _matrix(left["u"]), _matrix(right["there_u"]) if len(right) else None
            out = []
            ids = right["there_id"].combine_chunks() if len(right) else None
            rank = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable") if len(right) else None
            take = min(k + 1, len(right))
            for a in range(0, len(q) if len(right) else 0, 512):
                s = np.round(q[a : a + 512] @ v.T, 12)
                order = np.lexsort((np.broadcast_to(rank, s.shape), -s), axis=1)[:, :take] if take else np.zeros((len(s), 0), int)
                row = np.repeat(np.arange(len(s)), order.shape[1])
                out.append(pa.table({"query_id": left["id"].combine_chunks().take(pa.array(row + a)), "id": ids.take(pa.array(order.ravel())), "similarity": pa.array(s[row, order.ravel()])}))
            empty = pa.table({"query_id": left["id"].combine_chunks().slice(0, 0), "id": pa.array([], right.schema.field("there_id").type), "similarity": pa.array([], pa.float64())})
            return pa.concat_tables(out) if out else empty

        found = asked.select(*key, "id", "u").groupBy(*key).cogroup(there.groupBy("l", "r", "p", "b")).applyInArrow(best, f"query_id {kind}, id {other}, similarity double")
        return found.where("query_id <> id")

    def search(self, queries: DataFrame, id_: str, vector: str, k: int, path: str) -> DataFrame:
        """(query_id, id, similarity, rank) of the k nearest of each query among all vectors but those of its id."""
        size = self.centroids.shape[1]
        asked = stored(unit(queries, id_, vector).where(F.size("u") == size), f"{path}/queries")
        blocks = max(1, -(-asked.count() // BLOCK))
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        first = stored(ranked(self._near(stored(self._visits(asked, k, None), f"{path}/first_visits"), blocks, k + 1)), f"{path}/first")
        # a query that has no k vectors yet is near enough to all
        reach = first.groupBy("query_id").agg(F.count("*").alias("n"), F.sqrt(F.greatest(2 - 2 * F.min("similarity"), F.lit(0.0))).alias("d"))
        far = F.when(F.col("n") >= k, F.col("d") + 1e-6).otherwise(3.0)  # a distance from a similarity of 12 places
        more = asked.join(reach, F.col("query_id") == F.col("id"), "left").select("id", "u", F.coalesce(far, F.lit(3.0)).alias("enough"))
        visits = stored(self._visits(more, k, F.col("enough")), f"{path}/more_visits")
        return ranked(first.drop("rank").unionByName(self._near(visits, blocks, k + 1)))

    def share_read(self, path: str) -> float:
        """The share of (query, ring) pairs that a search with this path has read."""
        spark = self.members.sparkSession
        pairs = sum(spark.read.parquet(f"{path}/{name}").count() for name in ("first_visits", "more_visits"))
        return pairs / max(1, spark.read.parquet(f"{path}/queries").count() * len(self.rings))
