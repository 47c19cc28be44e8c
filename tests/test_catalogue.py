"""Every query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pytest

from rangeloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _rows(rows):
    return sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    names = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(f'\"{n}\"' for n in names)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert _rows(tuple(r[n] for n in names) for r in df.collect()) == _rows(found)


def test_entry_imports():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
