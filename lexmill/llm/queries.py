"""The thirteen operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, decontaminate, jaccard_join, mixing, source_audit, suffix_dedup, suffix_tree, token_files, token_spans, toxicity, url_filter, vector_codes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(table(spark, sf_dir, "documents"))


def op7_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.section_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_rows(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_tree, op2_jaccard_join, op3_mix, op4_warc, op5_toxicity, op6_audio, op7_token_spans, op8_decontaminate, op9_suffix_dedup, op10_token_files, op11_vector_codes, op12_url_filter, op13_source_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": mixing.MIX_SQL, "op4_warc": warc.WARC_SQL, "op8_decontaminate": decontaminate.REPORT_SQL, "op11_vector_codes": vector_codes.CODES_SQL, "op12_url_filter": url_filter.JUDGE_SQL, "op13_source_audit": source_audit.AUDIT_SQL}
