"""Text and rule functions on literals."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexmill.functions import rules, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("value, want", [("IV", 4), ("XIX", 19), ("", 0), ("ABC", 0), ("mcmxciv", 1994), ("I", 1)])
def test_roman(spark, value, want):
    assert one(spark, text.roman(F.col("x")), x=value) == want


@pytest.mark.parametrize("value, want", [("Primero", 1), ("DÉCIMO PRIMERO", 11), ("foo", None), ("Séptima", 7), ("último", 999), ("vigésimo quinto", 25), ("primero segundo", None)])
def test_ordinal(spark, value, want):
    assert one(spark, text.ordinal(F.col("x")), x=value) == want


@pytest.mark.parametrize("value, want", [("a 3 de febrero de 2004", "2004-02-03"), ("7/6/2024", "2024-06-07"), ("2024-06-07", "2024-06-07"), ("DOF 07-06-2024", "2024-06-07"), ("junk", None), ("40/13/2024", None), ("1 de enero de 1850", None)])
def test_any_date(spark, value, want):
    got = one(spark, text.any_date(F.col("x")), x=value)
    assert (str(got) if got else None) == want


def test_effective_date(spark):
    assert str(one(spark, text.effective_date(F.col("x")), x="El decreto entrará en vigor el día 1 de enero de 2025.")) == "2025-01-01"


def test_title_key_of_variants(spark):
    keys = {one(spark, text.title_key(F.col("x")), x=v) for v in ("Ley de la Energía", "LEY  ENERGIA", "Ley, de Energía.")}
    assert keys == {"ley energia"}


def test_natural_key(spark):
    rows = spark.createDataFrame([("Art. 10",), ("Art. 2",), ("Art. 10 Bis",)], "x string")
    assert [r["x"] for r in rows.orderBy(text.natural_key(F.col("x"))).collect()] == ["Art. 2", "Art. 10", "Art. 10 Bis"]


def test_slug_and_names(spark):
    assert one(spark, text.slug(F.col("x"), "_", 80, "unknown"), x="¡Código  Penal!") == "codigo_penal"
    assert one(spark, text.slug(F.col("x"), "_", 80, "unknown"), x="¡!") == "unknown"
    assert one(spark, text.clean_law_name(F.col("x")), x="Ley_del Agua (ABROGADA) 12-03-2001 TOMO_II") == "Ley del Agua"


def test_escapes(spark):
    assert one(spark, text.escape_xml(F.col("x")), x='<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, text.escape_latex(F.col("x")), x="5% & a_b") == r"5\% \& a\_b"
    assert [one(spark, text.duration_text(F.col("x")), x=v) for v in (5, 65, 3725)] == ["5s", "1m 5s", "1h 2m 5s"]


@pytest.mark.parametrize("income, want", [("0.01", "0.0000"), ("10135.11", "194.5939"), ("10135.12", "194.5900"), ("5107703.93", "1605679.5900"), ("0", "0.0000")])
def test_tax_edges(spark, income, want):
    assert one(spark, rules.tax(F.col("x")), x=Decimal(income)) == Decimal(want)


def test_tax_reference_mode(spark):
    assert one(spark, rules.tax(F.col("x"), reference_mode=True), x=Decimal("0")) < 0


@pytest.mark.parametrize("found, expected, conf, want", [(95, 100, 0.99, 96.2), (120, 100, 1.0, 96.5), (0, 0, 0.0, 0.0)])
def test_accuracy(spark, found, expected, conf, want):
    assert abs(one(spark, rules.accuracy(F.col("f"), F.col("e"), F.col("c")), f=float(found), e=float(expected), c=conf) - want) < 1e-9


@pytest.mark.parametrize("value, want", [("Se deroga.", True), ("Se deroga." + " x" * 60, False), ("(Derogado)", True), ("Otra cosa.", False)])
def test_derogated(spark, value, want):
    assert one(spark, rules.derogated(F.col("x")), x=value) is want


def test_article_confidence(spark):
    assert abs(one(spark, rules.article_confidence(F.col("x")), x="corto") - 0.7) < 1e-9
    assert one(spark, rules.article_confidence(F.col("x")), x="Para los efectos de esta ley se entiende por persona toda; " * 3) == 1.0


def test_classes(spark):
    assert one(spark, rules.law_status(F.col("x")), x="LEY DEL AGUA (ABROGADA)") == "abrogada"
    assert one(spark, rules.change_class(F.col("x")), x="Decreto por el que se reforma y deroga") == "abrogation"
    assert one(spark, rules.best_category(F.col("x")), x="Código Fiscal y ley de ingresos") == "Fiscal"
    assert one(spark, rules.best_category(F.col("x")), x="nada") == "Otros"
    assert one(spark, rules.error_class(F.col("k"), F.col("m"), F.lit(None).cast("string")), k="X", m="bad XML") == "PARSE_ERROR"
    assert one(spark, rules.health(F.lit(200), F.lit(True), F.col("x")), x=10_001) == "degraded"


@pytest.mark.parametrize("actions, want", [([], (0, "open")), (["escalate"] * 2, (2, "in_progress")), (["escalate"] * 5, (4, "blocked")), (["resolve", "escalate"], (0, "resolved"))])
def test_gap_after(spark, actions, want):
    got = spark.createDataFrame([(actions,)], "a array<string>").select(rules.gap_after(F.lit(0), F.lit("open"), F.col("a")).alias("g")).first()["g"]
    assert tuple(got) == want


def test_safe_pct(spark):
    assert [one(spark, rules.safe_pct(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((1, 3), (5, 4), (1, 0))] == [33.3, 100.0, None]
