"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; its result is written as Parquet
and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontaminate, jaccard_join, mixing, token_files, toxicity
from lexmill.llm._common import saved, setting
from lexmill.llm.queries import table, tokenizer_file

#: Bytes of rows that a task hands to its Python worker at once: both sides hold a batch, beside the heap that earlier stages have grown.
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """A stage whose Python passes, which all run before it returns, get batches of ``BATCH_BYTES``; a longer row is a batch of its own."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
            return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Null and empty texts stay; rows that share a doc_id (null is one too) with a rejected
    one go with it; without labels nothing goes; an empty table stays empty."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest doc_id, with its repeated rows. Null, empty and wordless texts
    are like no other and stay."""
    return jaccard_join.one_of_each(docs)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null, empty and wordless texts and items hold none; without items nothing goes."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that the mix takes twice is there twice. A null source is one, the last; null and empty
    texts have no size and aren't taken; an empty table stays empty."""
    return mixing.mixed_rows(docs)


@small_batches
def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens and ids_crc32. Null and empty texts are their end id; repeated rows are each there; a null
    doc_id comes first; an empty table gives no rows."""
    return token_files.token_rows(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmarks),
    ("source_mixing", mix_sources),
    ("token_files", write_token_ids),
]

#: A classifier, a similarity join and a tokenizer aren't expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
