"""Every query that has SQL gives the rows that DuckDB gives; the others run."""

import glob
import math
import os

import duckdb
import pytest

from tallyframe.plans import catalogue

FOLDER = os.environ.get("TALLYFRAME_TEST_TABLES", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return float(value) if type(value).__name__ == "Decimal" else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.SQL:
        answer = duck.sql(catalogue.SQL[name])
        assert sorted(df.columns) == sorted(answer.columns)
        assert got == rows(answer.columns, answer.fetchall())


def test_no_query_is_named_twice_and_all_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 100
