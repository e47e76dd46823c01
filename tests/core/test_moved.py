"""Moved ink at the very limit: rows are added in the table's order, however they are dealt out to tasks."""

import random
from functools import reduce
from operator import add

import duckdb
import pytest

from tallyframe.operators import rules
from tallyframe.plans import catalogue


@pytest.fixture
def limit(spark, tmp_path):
    """Pages whose discounts come to 0.15 but for rounding, in row groups that are read by several tasks, and the SQL's
    answers over one thread, which adds in the table's order."""
    rng, rows = random.Random(4), []
    for page in range(3000):
        cuts = sorted(rng.randint(0, 15) for _ in range(rng.randint(3, 7)))
        rows += [(page, (b - a) / 100) for a, b in zip([0, *cuts], [*cuts, 15], strict=True)]
    rng.shuffle(rows)
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql("CREATE TABLE l (k BIGINT, discount DOUBLE)")
    con.execute("INSERT INTO l SELECT unnest(?), unnest(?)", [[k for k, _ in rows], [x for _, x in rows]])
    path = f"{tmp_path}/lineitem.parquet"
    con.sql(f"COPY (SELECT k AS l_orderkey, 1.0::DOUBLE + k % 50 AS l_quantity, 0.01::DOUBLE * (k % 9) AS l_tax, discount AS l_discount FROM l) TO '{path}' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for key in keys:
        spark.conf.set(key, "8k")
    yield str(tmp_path), lambda name: con.sql(catalogue.SQL[name]).fetchall()
    for key in keys:
        spark.conf.unset(key)


def test_moved_pages_at_the_limit(spark, limit):
    folder, by_sql = limit
    want = set(by_sql("check_moved"))
    assert {tuple(r) for r in catalogue.QUERIES["check_moved"](spark, folder).collect()} == want and 0 < len(want) < 3000


def test_regions_at_the_limit(spark, limit):
    folder, by_sql = limit
    want = sorted(map(str, by_sql("check_regions")))
    assert sorted(str(tuple(r)) for r in catalogue.QUERIES["check_regions"](spark, folder).collect()) == want


def test_moved_pages_at_the_limit_are_counted(spark, limit):
    folder, by_sql = limit
    want = sorted(map(str, by_sql("check_softened")))
    assert sorted(str(tuple(r)) for r in catalogue.QUERIES["check_softened"](spark, folder).collect()) == want


def test_ink_is_added_in_the_order_asked(spark):
    parts, page = [0.1, 0.5, 0.7, 0.2], [(1, i) for i in range(4)]
    up, down = reduce(add, parts), reduce(add, reversed(parts))  # not sum(), which evens out
    assert up != down and max(up, down) == rules.MOVED
    for flip in (1, -1):
        df = spark.createDataFrame([(p, i * flip, 3.0 + i, x) for (p, i), x in zip(page, parts, strict=True)] + [(2, 0, 1.0, None), (None, 0, 4.0, 2.0)], "page int, i int, top double, removed double").repartition(3)
        got = {(r["page"], r["detail"]) for r in rules.moved_content(df, ["i"]).collect()}
        assert got == {(None, "4.0")} | ({(1, "3.0")} if (up if flip == 1 else down) >= rules.MOVED else set())
