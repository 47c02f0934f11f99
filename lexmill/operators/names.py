"""All names that texts contain, by Aho-Corasick automata.

An automaton over a list of names goes to the tasks and finds all of them in one pass over a text. Lists are measured before they are sent: beyond the bound,
names are dealt to shards by their first word, and the texts pass each shard's automaton in turn, so memory is bounded for any list; the results of
shards are merged by a partial aggregation. Each text or name keeps only its best partner, so no list of pairs is ever made.

Defined cases: null texts and names match nothing; the empty name is in every text; names are unique per text by their order, ties by the name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of names of an automaton, and bytes that a byte of them may take in it (a node a byte at most).
SHARD_BYTES, NODE_BYTES = 1_600_000, 40


def automaton(names: list[str]):
    """Over distinct names that aren't empty; values are their numbers."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, n in enumerate(names):
        made.add_word(n, i)
    if names:
        made.make_automaton()
    return made


def shards(names: DataFrame, limit: int = SHARD_BYTES) -> int:
    """How many automata the distinct names (name) need."""
    size = names.agg(F.sum(F.octet_length("name") + 1)).first()[0] or 0
    return max(1, -(-size // limit))


def _sent(spark: SparkSession, names: list[str]):
    made = automaton(names)
    if names and len(pickle.dumps(made)) > 4 * SHARD_BYTES * NODE_BYTES:
        raise ValueError("an automaton is larger than its names allow")
    return spark.sparkContext.broadcast((names, made))


def _dealt(names: DataFrame, limit: int) -> Iterator[list]:
    """Rows of (name, ...) shard by shard, to the driver: each is bounded."""
    names = names.where("name is not null")
    n = shards(names, limit)
    keyed = names.withColumn("shard", F.pmod(F.xxhash64(F.substring_index("name", " ", 1)), F.lit(n)))
    if n == 1:
        yield names.collect()
        return
    sizes = {r["shard"]: r["size"] for r in keyed.groupBy("shard").agg(F.sum(F.octet_length("name") + 1).alias("size")).collect()}
    for shard, size in sorted(sizes.items()):
        own, pieces = keyed.where(F.col("shard") == shard).drop("shard"), -(-size // (2 * limit))
        for piece in range(pieces):  # names of one first word are dealt once more
            yield own.where(F.pmod(F.xxhash64("name"), F.lit(pieces)) == piece).collect()


def best_contained(texts: DataFrame, text: str, names: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(text, name, rank) for each distinct text that holds any of ``names`` (name, rank: long), the one of least rank, then the first."""
    spark = texts.sparkSession
    own = names.groupBy("name").agg(F.min("rank").alias("rank"))
    asked = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    found = None
    for part in _dealt(own, limit):
        ranks = {r["name"]: r["rank"] for r in part}
        empty = ranks.pop("", None)
        sent = _sent(spark, sorted(ranks))
        order = spark.sparkContext.broadcast([(ranks[n], n) for n in sorted(ranks)])

        def match(batches: Iterator[pa.RecordBatch], sent=sent, order=order, empty=empty) -> Iterator[pa.RecordBatch]:
            (names, made), place = sent.value, order.value
            for batch in batches:
                out = []
                for t in batch.column("text").to_pylist():
                    best = min((place[i] for _, i in made.iter(t)), default=None) if names else None
                    if empty is not None:
                        best = min(best or (empty, ""), (empty, ""))
                    if best is not None:
                        out.append((t, best[1], best[0]))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], ["text", "name", "rank"])

        hits = asked.mapInArrow(match, "text string, name string, rank long")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = asked.select("text", F.col("text").alias("name"), F.lit(0).cast("long").alias("rank")).limit(0)
    best = found.groupBy("text").agg(F.min(F.struct("rank", "name")).alias("best"))
    return best.select("text", "best.name", "best.rank")


def best_holder(names: DataFrame, name: str, texts: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(name, text, rank) for each distinct name that any of ``texts`` (text, rank: long) holds: the text of least rank, then the first. A task keeps one text a name."""
    spark = texts.sparkSession
    asked = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    rows = texts.where(F.col("text").isNotNull()).select("text", "rank")
    found = None
    for part in _dealt(asked, limit):
        own = sorted(r["name"] for r in part)
        sent = _sent(spark, [n for n in own if n])
        empty = "" in own

        def match(batches: Iterator[pa.RecordBatch], sent=sent, empty=empty) -> Iterator[pa.RecordBatch]:
            names, made = sent.value
            best: dict[str, tuple[int, str]] = {}
            for batch in batches:
                for t, r in zip(batch.column("text").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                    for n in [*({names[i] for _, i in made.iter(t)} if names else ()), *([""] if empty else ())]:
                        if n not in best or (r, t) < best[n]:
                            best[n] = (r, t)
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array([t for _, t in best.values()], pa.string()), pa.array([r for r, _ in best.values()], pa.int64())], ["name", "text", "rank"])

        hits = rows.mapInArrow(match, "name string, text string, rank long")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = asked.select("name", F.col("name").alias("text"), F.lit(0).cast("long").alias("rank")).limit(0)
    best = found.groupBy("name").agg(F.min(F.struct("rank", "text")).alias("best"))
    return best.select("name", "best.text", "best.rank")


def position(order: Column, length: Column) -> Column:
    """A rank that puts long names first, then a list's own order (below 2**31)."""
    return F.shiftleft(F.lit((1 << 31) - 1).cast("long") - length, 31) + order.cast("long")
