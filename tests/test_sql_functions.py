"""SQL functions and the parser's table function give what the DataFrame forms give."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import parse
from lexmill.plans import sql_functions

LAWS = [
    (1, "LEY\nTÍTULO I\nUno\nArtículo 1. Texto\nsigue\n\nArtículo 2o Bis 1.- Otro. Artículo reformado DOF 07-06-2024\nCAPÍTULO II\nSuelto\nArtículo 1. repetido\nArtículo 27-A. Fin\nTRANSITORIOS\nArtículo 3. no"),
    (2, "Art. 12 corto\nSECCIÓN PRIMERA\nArtículo 5o"), (3, ""), (4, None), (5, "Artículo 1. única línea\n  Transitorios  \nPRIMERO"),
]


def test_table_function(spark):
    sql_functions.register(spark)
    docs = spark.createDataFrame(LAWS, "doc int, text string")
    parse.lines(docs, "doc", "text").createOrReplaceTempView("lines_of_laws")
    got = spark.sql("SELECT * FROM parse_law(TABLE(SELECT * FROM lines_of_laws))").collect()
    want = parse.articles(docs, "doc", "text").select("doc", "article_id", "content", "line_number").collect()
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in got if r["kind"] == "article") == sorted(map(tuple, want)) and len(want) == 6
    heads = parse.structures(docs, "doc", "text").select("doc", "kind", "line_number").collect()
    assert sorted((r["doc"], r["kind"], r["line_number"]) for r in got if r["kind"] != "article") == sorted(map(tuple, heads))
    with pytest.raises(Exception, match="line_number"):
        spark.sql("SELECT * FROM parse_law(TABLE(SELECT doc FROM lines_of_laws))").collect()


def test_functions_are_the_rules(spark):
    names = sql_functions.register(spark)
    rows = spark.createDataFrame([(t,) for t in ("Artículo 5 Bis. Ley", "Se deroga.", "CAPÍTULO II", "3 de febrero de 2004", "<?xml a", "décimo primero", "", None)], "x string")
    rows.createOrReplaceTempView("texts_of_laws")
    for name in names[:-1]:
        got = [r[0] for r in spark.sql(f"SELECT {name}(x) FROM texts_of_laws").collect()]
        assert got == [r[0] for r in rows.select(sql_functions.FUNCTIONS[name](F.col("x"))).collect()], name
    plan = spark.sql("SELECT derogated(x) FROM texts_of_laws")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
