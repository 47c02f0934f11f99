"""The pipeline's stages, each on its own input, and the whole."""

import zlib

import numpy as np
from brute import contaminated, near_duplicates
from tokenizers import Tokenizer

import corpus_pipeline
from lexmill.llm.queries import tokenizer_file

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, DATA)
    assert clean.columns == names and 0 < clean.count() <= docs.count()
    single = stages["ngram_jaccard_join"](spark, docs, DATA)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert single.columns == names and {r["doc_id"] for r in single.collect()} == {c for _, _, c in near_duplicates(rows)}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = stages["benchmark_decontamination"](spark, docs, DATA)
    assert kept.columns == names and {r["doc_id"] for r in kept.collect()} == {r[0] for r in contaminated(rows, items) if not r[5]}
    assert stages["source_mixing"](spark, docs, DATA).columns == names


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, digest string, size string, toxic string, keep string, row string"


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty, repeated and very long texts, and extra columns with names that operators use inside."""
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (2, None, None, None, None), (None, "x y", "fr", "b", 3), (3, "", "de", "", 0), (4, "plain word " * 20000, "en", "b", 2), (5, "one two three four five six", "en", "c", 1)]
    docs = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    every = sorted(str(r["doc_id"]) for r in docs.collect())
    left = {"toxicity": every, "ngram_jaccard_join": ["1", "1", "2", "3", "4", "None"], "benchmark_decontamination": every}
    for name, want in left.items():
        got = stages[name](spark, docs, DATA)
        assert got.columns == docs.columns and sorted(str(r["doc_id"]) for r in got.collect()) == want, name
    mix = stages["source_mixing"](spark, docs, DATA)
    assert mix.columns == docs.columns and {r["doc_id"] for r in mix.collect()} <= {1, 4, 5, None}
    tokens = stages["token_files"](spark, docs, DATA).collect()
    assert sorted(str(r["doc_id"]) for r in tokens) == every
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), DATA).collect() == [], name


def test_whole(spark):
    rows = corpus_pipeline.run(spark, DATA).orderBy("start").collect()
    assert rows and rows[0]["start"] == 0 and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    made = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    for r in rows[:20]:
        ids = [*made.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
