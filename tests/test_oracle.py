"""Every reference query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from lexmill import queries as reference

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(found):
    def value(v):
        if v is None:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.9g}"
        return str(v).replace(" 00:00:00", "")

    return sorted(tuple(value(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(reference.oracle_sql()))
def test_query(spark, duck, name):
    got = reference.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in names)} FROM ({reference.oracle_sql()[name]})").fetchall()
    assert rows(got.select(*[f"`{c}`" for c in names]).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(reference.queries()) - set(reference.oracle_sql())))
def test_rows_only(spark, name):
    assert reference.queries()[name](spark, DATA).take(1)
