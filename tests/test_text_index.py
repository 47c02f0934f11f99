"""The analyser and the stored text index against plain forms."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators import analysis, search, text_index
from lexmill.operators.text_index import TextIndex, single

WORDS = {
    "luces": "luz", "leyes": "ley", "meses": "mes", "intereses": "interes", "artículos": "articul", "amparo": "ampar", "tres": "tres", "nación": "nacion", "españoles": "español", "crisis": "crisis", "veces": "vez", "México": "mexic",
}


def test_stems_and_stops(spark):
    got = spark.createDataFrame(list(WORDS.items()), "w string, want string").select("want", analysis.stem(F.lower("w")).alias("got"), "w").collect()
    assert all(r["got"] == r["want"] == analysis.plain_stem(r["w"].lower()) for r in got), got
    assert len(analysis.STOPS) == 308 and {"fue", "muy", "durante", "hasta", "tuviésemos", "habréis", "seáis", "vuestras"} <= set(analysis.STOPS)


def tokens(spark, text):
    rows = spark.createDataFrame([(text,)], "t string").select(analysis.analysed(F.col("t")).alias("x")).first()["x"]
    return None if rows is None else [tuple(r) for r in rows]


TEXTS = [
    "La Carta Magna de los Estados", "constitución", "Ley del Impuesto sobre la Renta vigente", "Constitución Política de los Estados Unidos Mexicanos y su carta magna", "l'état 3.14 art.5 1,000.5 a_b ñandú fé", "medio de defensa", "", "de la",
    "medio de", "ley ley fundamental ley", "¡Más!", "Diario Oficial de la Federación: NOM, norma oficial mexicana", "disposición; multa.Penalidad",
]


def test_graph_of_synonyms(spark):
    assert tokens(spark, None) is None and tokens(spark, "") == []
    assert tokens(spark, "de carta magna") == [("cart", 1, 1), ("constitucion", 1, 2), ("carta_magna", 1, 2), ("ley_fundamental", 1, 2), ("magn", 2, 1)]
    assert {t for t, _, _ in tokens(spark, "ñoño")} == {"ñoño", "nono"}
    assert [t for t in tokens(spark, "nom")] == [("nom", 0, 1), ("norma_oficial_mexicana", 0, 1)]
    for text in TEXTS:
        assert sorted(tokens(spark, text)) == sorted(set(analysis.plain_analysed(text))), text


def test_analyser_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in docs.select("text", analysis.analysed(F.col("text")).alias("x")).collect():
        assert sorted(map(tuple, r["x"])) == sorted(set(analysis.plain_analysed(r["text"])))


def plain_phrase(text, phrase):
    """Every way through the phrase is tried at every token."""
    doc = {}
    for t, at, span in analysis.plain_analysed(text):
        doc.setdefault((t, at), set()).add(at + span)

    def walk(way, at):
        if not way:
            return True
        alike, gap = way[0]
        return any(walk(way[1:], end) for t in alike for end in doc.get((t, at + gap), ()))

    starts = range(len(text) + 1)
    return any(walk([(way[0][0], 0), *way[1:]], at) for way in analysis.paths(analysis.plain_analysed(phrase)) for at in starts if way)


def test_phrases(spark, tmp_path):
    rng = random.Random(4)
    pieces = ["carta magna", "constitución", "carta", "magna", "ley", "fundamental", "ley fundamental", "de", "la", "renta", "multa", "sanción", "nom", "norma oficial mexicana", "norma"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randint(0, 7)))) for i in range(150)] + [(150, None)]
    index = TextIndex.build(spark.createDataFrame(rows, "id int, text string"), "id", {"text": (F.col("text"), analysis.analysed)}, str(tmp_path / "ix"))
    for phrase in ("carta magna", "constitución de la renta", "multa nom", "norma oficial mexicana multa", "ley fundamental carta", "de la", "renta de renta", "nunca"):
        got = sorted(r["doc"] for r in analysis.phrase_docs(index.postings, analysis.plain_analysed(phrase)).collect())
        assert got == [i for i, t in rows if t and plain_phrase(t, phrase)], phrase


def texts(seed, n=400):
    """Word frequencies fall off, and many texts are alike, so that scores tie."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    made = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(1, 40))) for _ in range(n // 2)]
    return [(i, rng.choice(made), f"n{i % 7} w{i % 5}") for i in range(n)]


def exhaustive(rows, asked, boosts, k, extra=lambda i: 0.0, keep=lambda i: True):
    fields = {"text": [r[1].split() for r in rows], "name": [r[2].split() for r in rows]}
    best = Counter()
    for f, boost in boosts.items():
        docs = fields[f]
        avg = sum(map(len, docs)) / len(docs)
        df = Counter(t for d in docs for t in set(d))
        for (i, *_), d in zip(rows, docs, strict=True):
            tf = Counter(d)
            part = lambda t: tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / avg))
            s = sum(w * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * part(t) for g, t, w in asked if g == f and tf[t])
            if s and keep(i):
                best[i] = max(best[i], boost * s)
    scored = [(round(s + extra(i), 9), i) for i, s in best.items()]
    return [i for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = texts(1)
    frame = spark.createDataFrame(rows, "id int, text string, name string")
    plain = single(search.tokens)
    text_index.BLOCK, before = 16, text_index.BLOCK
    index = TextIndex.build(frame, "id", {"text": (F.col("text"), plain), "name": (F.col("name"), plain)}, str(tmp_path_factory.mktemp("ix") / "ix"))
    text_index.BLOCK = before
    return rows, frame, index


@pytest.mark.parametrize("asked", [["w0"], ["w59"], ["w0", "w1", "w2"], ["w3", "w50", "n2"], ["w0", "nothing"], ["nothing"]])
@pytest.mark.parametrize("k", [1, 20])
def test_top_equals_the_exhaustive_score(built, asked, k):
    rows, _, index = built
    terms = [(f, t, 0.5 if t == "w2" else 1.0) for f in ("text", "name") for t in asked]
    answer = index.top(terms, k, {"text": 1.0, "name": 3.0})
    assert [r["doc"] for r in answer.hits.collect()] == exhaustive(rows, terms, {"text": 1.0, "name": 3.0}, k)
    assert answer.read <= answer.blocks
    if asked == ["w0"] and k == 1:
        one = index.top([("text", "w0", 1.0)], 1)
        assert one.read < one.blocks


def test_top_with_a_filter_and_a_bonus(built):
    rows, frame, index = built
    allowed = frame.where("id % 3 = 0").select(F.col("id").alias("doc"), F.when(F.col("id") % 2 == 0, 1.5).otherwise(0.0).alias("extra"))
    terms = [("text", t, 1.0) for t in ("w1", "w4", "w20")]
    got = [r["doc"] for r in index.top(terms, 15, {"text": 1.0}, allowed, 1.5).hits.collect()]
    assert got == exhaustive(rows, terms, {"text": 1.0}, 15, lambda i: 1.5 * (i % 2 == 0), lambda i: i % 3 == 0)
    none = allowed.limit(0)
    assert index.top(terms, 15, {"text": 1.0}, none, 1.5).hits.collect() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_near_spellings(spark):
    rng = random.Random(7)
    vocabulary = sorted({"".join(rng.choices("abé", k=rng.randint(1, 12))) for _ in range(400)} | {"", "x", "prefijolargo1", "prefijolargo12", "prefijolarg", "refijolargo1", "zzprefijolargo1"})
    table = text_index.spellings(spark.createDataFrame([(t,) for t in vocabulary], "term string"))
    asked = rng.sample(vocabulary, 60) + ["", "ab", "zz", "abcde", "prefijolargo1"]
    got = {tuple(r) for r in text_index.near_spellings(table, spark.createDataFrame([(a,) for a in set(asked)], "asked string")).collect()}
    edits = lambda a: 0 if len(a) <= 2 else 1 if len(a) <= 5 else 2
    assert got == {(a, v, distance(a, v)) for a in asked for v in vocabulary if distance(a, v) <= edits(a)}


def test_completions(spark, tmp_path):
    rng = random.Random(8)
    names = [rng.choice(["Ley", "ley", "Código", "Ñ", "L"]) + " " + "".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(300)] + [None, "", "é", "Ley", "Ley"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    table = text_index.store_completions(frame, "name", str(tmp_path / "c"))
    each = sorted({n for n in names if n is not None})
    prefixes = {n.lower()[:k] for n in each for k in range(2, 7) if len(n) >= k}
    assert sorted(map(tuple, table.collect())) == sorted((p, i + 1, n) for p in prefixes for i, n in enumerate([n for n in each if n.lower().startswith(p)][:8]))
    asked = ["LEY", "ley abc", "ley abcabc", "igo a", "l", "", "zz", "Ley b"]
    got = {}
    for r in sorted(text_index.complete(spark.createDataFrame([(a,) for a in asked], "asked string"), table, frame, "name").collect()):
        got.setdefault(r["asked"], []).append(r["name"])
    for a in asked:
        begun = [n for n in each if n.lower().startswith(a.lower())]
        want = (begun or [n for n in each if a.lower() in n.lower()])[:8] if len(a) >= 2 else []
        assert got.get(a, []) == want, a

def test_near_few(spark):
    """A query's terms by a scan of a vocabulary whose terms repeat."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abé", k=rng.randint(0, 9))) for _ in range(400)]
    asked = rng.sample(vocabulary, 20) + ["zz", "abcde"]
    got = [tuple(r) for r in text_index.near_few(spark.createDataFrame([(t,) for t in vocabulary], "term string"), spark.createDataFrame([(a,) for a in asked], "asked string")).collect()]
    edits = lambda a: 0 if len(a) <= 2 else 1 if len(a) <= 5 else 2
    assert sorted(got) == sorted({(a, v, distance(a, v)) for a in asked for v in vocabulary if distance(a, v) <= edits(a)})


def test_postings_are_stored_once(spark, tmp_path, monkeypatch):
    """Postings, lengths and places of texts cut into many batches; no second table of their size."""
    import os

    monkeypatch.setattr(text_index, "PARTITION", 50)
    rows = [(i, t) for i, t, _ in texts(3, 60)] + [(60, None), (61, "")]
    index = TextIndex.build(spark.createDataFrame(rows, "id int, text string"), "id", {"text": (F.col("text"), single(search.tokens)), "none": (F.lit(None).cast("string"), single(search.tokens))}, str(tmp_path / "ix"))
    want = {(w, i, len(t.split()), tuple(k for k, x in enumerate(t.split()) if x == w)) for i, t in rows if t for w in set(t.split())}
    assert {(r["term"], r["doc"], r["dl"], tuple(p["at"] for p in r["places"])) for r in index.postings.collect()} == want
    assert sorted(os.listdir(index.path)) == ["analysed", "bands", "postings", "stats"]
    total = sum(len(t.split()) for _, t in rows if t)
    assert {tuple(r) for r in index.stats.collect()} == {("text", 62, total / 62), ("none", 62, 0.0)}
    assert index.table("bands").agg(F.sum("n")).first()[0] == len(want)


def test_tokens_are_grouped_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(text_index, "TOKENS", 4)
    token = lambda t, at, span=1: {"term": t, "at": at, "span": span}
    docs = [[token("b", 0), token("a", 0, 2), token("b", 2), token("a", 1)], [], None, [token("a", 0)] * 2 + [token("c", 3)], [token("d", k) for k in range(9)]]
    kind = pa.list_(pa.struct([("term", pa.string()), ("at", pa.int32()), ("span", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["f"] * 5), pa.array(docs, kind)], ["doc", "field", "tokens"])
    made = [b.to_pylist() for b in text_index.group_tokens(iter([batch]))]
    got = [(r["term"], r["doc"], r["dl"], r["tf"], [*zip(r["at"], r["span"] or [1] * r["tf"], strict=True)], r["own"]) for b in made for r in b]
    assert got[:2] == [("a", 0, 3, 2, [(0, 2), (1, 1)], 3), ("b", 0, 3, 2, [(0, 1), (2, 1)], 0)]
    assert got[2:] == [("a", 3, 2, 2, [(0, 1), (0, 1)], 2), ("c", 3, 2, 1, [(3, 1)], 0), ("d", 4, 9, 9, [(k, 1) for k in range(9)], 9)] and len(made) > 2


def test_one_query_stores_no_index(spark, monkeypatch):
    """R2_multi_field makes rows for its own terms only."""
    from lexmill import law_queries  # noqa: F401
    from lexmill.queries import QUERIES

    monkeypatch.setattr(search, "store_index", None)
    assert QUERIES["R2_multi_field"](spark, "/root/testdata/sf0.001").count() > 0


def test_long_terms_meet_by_their_ends_too(spark):
    """Of terms with one beginning of ten letters only near ones meet, so candidates don't grow with the square of a family of words."""
    rng = random.Random(10)
    vocabulary = sorted({"gemeinsame" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(300)})
    table = text_index.spellings(spark.createDataFrame([(t,) for t in vocabulary], "term string"))
    met = table.join(table.withColumnRenamed("term", "other"), "form").select("term", "other").distinct().count()
    assert met < len(vocabulary) ** 2 / 2
    asked = vocabulary[:50]
    got = {tuple(r) for r in text_index.near_spellings(table, spark.createDataFrame([(a,) for a in asked], "asked string")).collect()}
    assert got == {(a, v, distance(a, v)) for a in asked for v in vocabulary if distance(a, v) <= 2}


@pytest.mark.parametrize("name", ["R3_fuzzy", "R3_spellings", "R6_in_law"])
def test_spellings_need_no_postings(spark, monkeypatch, name):
    from lexmill import search_queries  # noqa: F401
    from lexmill.queries import QUERIES

    monkeypatch.setattr(TextIndex, "build", None)
    monkeypatch.setattr(search_queries, "_made", {})
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_words_are_not_stemmed_one_by_one(spark):
    """No expression is evaluated for each word; places, ends of texts and repeats are those of the plain form."""
    texts = ["ley ley fundamental", None, "", "carta", "magna carta magna", "norma oficial", "mexicana nom", "ley del impuesto sobre la renta ley del impuesto", "Leyes de la ley"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1).select("id", analysis.analysed(F.col("t")).alias("x"))
    assert {r["id"]: r["x"] and [*map(tuple, r["x"])] for r in found.collect()} == {i: t if t is None else list(analysis.plain_analysed(t)) for i, t in enumerate(texts)}
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_law_only_filters(spark):
    """A query within a law is fuzzy, and weighs terms by all documents, as one without the law does."""
    from lexmill import search_queries  # noqa: F401
    from lexmill.queries import ORACLE

    texts = ["the law", "thee law law", "the then", "a law", "their law", "the the code"]
    docs = spark.createDataFrame([(i, f"l{i % 2}", t) for i, t in enumerate(texts)], "doc_id int, law_id string, text string")
    index, stats = search.inverted_index(docs, "doc_id", ["text"]), search.field_stats(docs, ["text"])
    articles = docs.select("law_id", F.col("doc_id").alias("article"))
    got = [(r["doc"], r["score"]) for r in search.in_law(index, stats, articles, "l1", ["the"]).collect()]
    words = spark.createDataFrame(search.spelt(index, ["the"]), "term string, weight double")
    every = search.bm25(index.join(words, "term"), stats, ["the", "thee"], weight="weight").collect()
    assert got == sorted(((r["doc"], round(r["score"], 9)) for r in every if r["doc"] % 2), key=lambda x: (-x[1], x[0])) and [d for d, _ in got] == [1, 5]
    assert "levenshtein" in ORACLE["R6_in_law"]
