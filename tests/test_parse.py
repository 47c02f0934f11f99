"""Law texts on literal fixtures."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.operators import parse

LAW = """LEY DE PRUEBA
TÍTULO I
Disposiciones Generales
CAPÍTULO I
Objeto
Artículo 1. Esta ley es de orden público; rige en todo el país.
Sigue en otra línea.
Artículo 2o.- Para los efectos de esta ley se estará a lo siguiente:
I. Uno
a) Dos
Artículo 2 Bis 1. Texto del bis. Artículo reformado DOF 07-06-2024
CAPÍTULO II
De otra cosa
Artículo 5-A. Se deroga.
Artículo 1. Repetido.
TRANSITORIOS
PRIMERO.- Entrará en vigor mañana.
Más texto.
DÉCIMO SEGUNDO. Otro.
Artículo 9. No es del cuerpo."""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, LAW)], "id int, text string")


@pytest.mark.parametrize("line, want", [("Artículo 1o-A", "art-1a"), ("Artículo 27-A.", "art-27a"), ("Artículo 5o. Bis 1", "art-5bis1"), ("ARTICULO 5", "art-5"), ("Art. 12", "art-12"), ("según el artículo 5", None)])
def test_article_id(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(parse.article_id(F.col("x"))).first()[0] == want


def test_articles(docs):
    rows = {r["article_id"]: r for r in parse.articles(docs, "id", "text").collect()}
    assert set(rows) == {"art-1", "art-2", "art-2bis1", "art-5a"}
    assert rows["art-1"]["content"] == "Esta ley es de orden público; rige en todo el país.\nSigue en otra línea."
    assert rows["art-2bis1"]["content"] == "Texto del bis." and rows["art-2bis1"]["reforms"][0]["dof_date"] == "07-06-2024"
    assert rows["art-5a"]["derogated"] and not rows["art-1"]["derogated"]


def test_structures(docs):
    got = [(r["kind"], r["number"], r["description"]) for r in parse.structures(docs, "id", "text").orderBy("line_number").collect()]
    assert got == [("title", 1, "Disposiciones Generales"), ("chapter", 1, "Objeto"), ("chapter", 2, "De otra cosa")]


def test_transitory(docs):
    got = sorted((r["number"], r["content"].split("\n")[0]) for r in parse.transitory_articles(docs, "id", "text").collect())
    assert got == [(1, "Entrará en vigor mañana."), (12, "Otro.")]


def test_gaps_metadata_and_completeness(docs):
    arts = parse.articles(docs, "id", "text")
    assert [tuple(r) for r in parse.law_gaps(arts, "id").collect()] == [(1, 2, 5)] and not parse.law_gaps(arts, "id", 5).collect()
    meta = parse.metadata(docs, arts, parse.structures(docs, "id", "text"), parse.transitory_articles(docs, "id", "text"), "id")
    row = meta.first()
    assert (row["n_articles"], row["n_structures"], row["n_transitory"], row["warnings"]) == (4, 3, 2, ["gaps"])


def test_references_and_overlaps(spark):
    text = "Conforme al artículo 5 de la Ley de Amparo; la fracción III del artículo 107, la Ley Federal de Protección al Consumidor."
    rows = parse.references(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("start").collect()
    assert [(r["article_num"], r["fraction"]) for r in rows] == [("5", None), ("107", "III"), (None, None)]
    assert all(text[r["start"] : r["end"]] == r["text"] for r in rows)
    assert all(a["end"] <= b["start"] for a, b in zip(rows, rows[1:])) and rows[0]["confidence"] == pytest.approx(0.9, abs=0.11)


def test_parents(spark):
    rows = spark.createDataFrame([(1, "title", "T1", 1), (1, "chapter", "C1", 2), (1, "article", "a", 3), (1, "title", "T2", 4), (1, "article", "b", 5)], "id int, kind string, label string, line_number int")
    got = {r["label"]: (r["title"], r["chapter"]) for r in parse.parents(rows, "id").collect()}
    assert got["a"] == ("T1", "C1") and got["b"] == ("T2", None)


def test_akn_round_trip(docs, spark):
    heads = parse.structures(docs, "id", "text").select("id", "kind", F.concat_ws(" ", "kind", F.col("number").cast("string")).alias("label"), F.lit(None).cast("string").alias("content"), "line_number")
    arts = parse.articles(docs, "id", "text").select("id", F.lit("article").alias("kind"), F.col("article_id").alias("label"), "content", "line_number")
    xml = parse.akn_document(heads.unionByName(arts), "id")
    got = {r["eid"]: (r["title"], r["chapter"], r["text"]) for r in parse.akn_elements(xml, "id", "xml").collect()}
    assert set(got) == {"art-1", "art-2", "art-2bis1", "art-5a"} and got["art-5a"] == ("title 1", "chapter 2", "Se deroga.") and got["art-1"][:2] == ("title 1", "chapter 1")
    assert {r["check"] for r in parse.completeness(xml, "id", "xml").collect()} == {"frbr_metadata", "content_length"}
    assert not parse.schema_validity(xml, "id", "xml").collect()
    bad = spark.createDataFrame([(1, "<a>"), (2, "<akomaNtoso><act/></akomaNtoso>"), (3, None)], "id int, xml string")
    assert {tuple(r) for r in parse.schema_validity(bad, "id", "xml").collect()} == {(1, "not_well_formed"), (3, "not_well_formed"), (2, "no_meta"), (2, "no_body")}


def test_small_patterns(spark):
    row = spark.createDataFrame([("conforme al artículo 12 y según el artículo 12",)], "x string")
    assert row.select(parse.simple_references(F.col("x"))).first()[0] == ["12"]
    lines = spark.createDataFrame([("I. uno",), ("a) dos",), ("1) tres",), ("nada",)], "x string")
    assert [r[0] for r in lines.select(parse.is_fraction(F.col("x"))).collect()] == [True, True, True, False]


def test_article_texts_as_the_indexer_makes_them(spark):
    probes = {
        "Artículo 5 Bis. Texto": "Texto", "uno;\ndos": "uno; dos", "2020\nsigue": "2020\nsigue", ")\n1.": ")\n1.", "a\nb\nC": "a b C", "fin.\nOtra": "fin.\nOtra", "Á\nÑ": "Á Ñ",
        "ARTÍCULO 7.- Uno": "- Uno", "ARTICULO 3. Uno": "ARTICULO 3. Uno", "  dos   espacios ": "dos espacios", "Artículo 9o sin punto": "Artículo 9o sin punto", "": "",
    }
    rows = spark.createDataFrame(list(probes.items()), "t string, want string").select("t", "want", parse.clean_article_text(F.col("t")).alias("got")).collect()
    assert all(r["got"] == r["want"] == parse.clean_paragraph(r["t"]) for r in rows), rows
    xml = f'<a xmlns="{parse.AKN}"><article id="x"><num>Artículo 1</num><content><p>Artículo 1. Uno\ndos</p><note><p>reformado</p></note><p> </p><p>tres</p></content></article><article id="y"><num>Art 2</num>Art 2 suelto</article></a>'
    got = parse.akn_elements(spark.createDataFrame([(1, xml)], "k int, xml string"), "k", "xml").collect()
    assert [r["text"] for r in got] == ["Uno dos\n\ntres", "Art 2 suelto"]


def test_documents_of_a_batch_are_read_one_after_another():
    read = []

    def check(x):
        read.append(x)
        return [("a", x)] if x else []

    batch = pa.RecordBatch.from_arrays([pa.array(range(150), pa.int32()), pa.array([None if i % 3 else str(i) for i in range(150)])], ["k", "xml"])
    made = parse._row_by_row(check, 2)(iter([batch]))
    first = next(made)
    assert len(read) == parse.ROWS == 64 and first.schema.types == [pa.int32(), pa.string(), pa.string()]
    rows = [tuple(r.values()) for b in (first, *made) for r in b.to_pylist()]
    assert rows == [(i, "a", str(i)) for i in range(0, 150, 3)] and len(read) == 150
    assert [b.num_rows for b in parse._row_by_row(check, 2)(iter([batch.slice(1, 1)]))] == [0]
