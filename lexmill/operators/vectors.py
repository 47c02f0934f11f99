"""Vectors and text differences."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..plans.folders import folder


def embedding_input(text: Column, words: int = 300) -> Column:
    """The first words of a stripped text; null where there is none."""
    return F.nullif(F.array_join(F.slice(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), 1, words), " "), F.lit(""))


def zero_vector(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """NaN where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.when(a.isNotNull() & b.isNotNull(), float("nan")))


#: Query vectors whose matrix is sent to each task.
QUERIES = 4096


def nearest(vectors: DataFrame, queries: DataFrame, id_: str, vector: str, k: int = 5, block: int = QUERIES) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of each query among all vectors but itself; equal ones (to 12 places) by id. Zero and null vectors are near to nothing.

    Up to ``block`` queries are sent to the tasks, and vectors stream by them once, each task keeping k rows for a query of each batch. More of them meet the vectors through an index
    of inverted lists, by shuffle, with the same result."""
    spark = vectors.sparkSession
    each = queries.where(F.col(vector).isNotNull()).select(F.col(id_), F.col(vector))
    kind = vectors.schema[id_].dataType.simpleString()
    if each.limit(block + 1).count() > block:
        from .vector_index import VectorIndex

        base = folder(spark)
        found = VectorIndex.build(vectors, id_, vector, f"{base}/index").search(each, id_, vector, k, f"{base}/search")
        return found.select("query_id", F.col("id").alias(id_), "similarity", "rank")
    found = _block(vectors, each.toArrow(), id_, vector, k, kind)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of unit length; NaN for zero vectors."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _block(vectors: DataFrame, part: pa.Table, id_: str, vector: str, k: int, kind: str) -> DataFrame:
    if not part.num_rows:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, {id_} {kind}, similarity double")
    sent = vectors.sparkSession.sparkContext.broadcast((part.column(id_).combine_chunks(), _unit(part.column(vector))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        for batch in batches:
            if not len(batch):
                continue
            own, v = batch.column(id_), _unit(batch.column(vector))
            take = min(k + 1, len(batch))  # one may be the query itself
            for a in range(0, len(q), 512):
                s = np.round(np.nan_to_num(q[a : a + 512] @ v.T, nan=-2.0), 12)
                order = np.lexsort((np.broadcast_to(own.to_numpy(zero_copy_only=False), s.shape), -s), axis=1)[:, :take]
                row = np.repeat(np.arange(len(s)), take)
                out = pa.table({"query_id": names.take(pa.array(row + a)), id_: own.take(pa.array(order.ravel())), "similarity": pa.array(s[row, order.ravel()])})
                same = pc.or_(pc.equal(out["query_id"], out[id_]), pc.less(out["similarity"], -1.5))
                yield from out.filter(pc.invert(same)).combine_chunks().to_batches()

    return vectors.where(F.col(vector).isNotNull()).select(id_, vector).mapInArrow(near, f"query_id {kind}, {id_} {kind}, similarity double")


@F.pandas_udf(ArrayType(StructType([StructField("op", StringType()), StructField("words", StringType())])))
def word_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Equal, deleted and inserted runs of words."""

    def one(x: str, y: str) -> list[dict]:
        p, q, out = (x or "").split(), (y or "").split(), []
        for op, i, j, k, m in difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
            if op == "equal":
                out.append({"op": "equal", "words": " ".join(p[i:j])})
            else:
                out += [{"op": n, "words": " ".join(w)} for n, w in (("delete", p[i:j]), ("insert", q[k:m])) if w]
        return out

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def word_changes(a: Column, b: Column) -> Column:
    """D1's set form: words gone and words new."""
    wa, wb = (F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "") for c in (a, b))
    return F.struct(F.array_sort(F.array_except(wa, wb)).alias("removed"), F.array_sort(F.array_except(wb, wa)).alias("added"))
