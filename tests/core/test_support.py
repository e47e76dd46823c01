"""Greedy groupings and symbols against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from tallyframe.functions.symbols import code128
from tallyframe.operators import greedy


def test_lines_take_the_last_that_fits(spark):
    rng = np.random.default_rng(0)
    rows = [(p, i, float(t), float(t + h)) for p in range(3) for i, (t, h) in enumerate(zip(rng.uniform(0, 60, 40), rng.uniform(2, 8, 40), strict=True))]
    want = {}
    for p in range(3):
        lines = []
        for q, i, t, b in rows:
            if q != p:
                continue
            hit = [k for k, line in enumerate(lines) if any((min(b, b2) - max(t, t2)) / min(b - t, b2 - t2) > 0.35 for t2, b2 in line)]
            if hit:
                lines[hit[-1]].append((t, b))
            else:
                lines.append([(t, b)])
            want[p, i] = (hit[-1] if hit else len(lines) - 1) + 1
    got = greedy.lines_by_overlap(spark.createDataFrame(rows, "p int, i long, t double, b double"), "p", "i", "t", "b").collect()
    assert {(r["p"], r["i"]): r["line"] for r in got} == want


def test_stacks_grow(spark):
    rows = [(1, i, float(x), 0.0) for i, x in enumerate([0, 5, 1, 2, 3, 4])]
    got = greedy.stacked(spark.createDataFrame(rows, "p int, i long, x double, y double"), "p", "i", "x", "y", 1.0, 1.0).collect()
    assert sorted((r["first"], r["n"], r["x0"], r["x1"]) for r in got) == [(0, 5, 0.0, 4.0), (1, 1, 5.0, 5.0)]


def test_shapes_near_one_that_stays_go(spark):
    rng = np.random.default_rng(2)
    rows = [(p, i, float(a), float(b)) for p in range(2) for i, (a, b) in enumerate(rng.uniform(0, 20, (80, 2)))]
    want = set()
    for p in range(2):
        kept = []
        for q, i, a, b in rows:
            if q == p and not any(abs(a - x) <= 1.5 and abs(b - y) <= 1.5 for _, x, y in kept):
                kept.append((i, a, b))
        want |= {(p, i) for i, *_ in kept}
    got = greedy.distinct_shapes(spark.createDataFrame(rows, "p int, i long, a double, b double"), "p", "i", ["a", "b"], 1.5)
    assert {(r["p"], r["i"]) for r in got.collect()} == want


def read_back(values):
    """The text of Code 128 values."""
    start, *body, check, stop = values
    assert stop == 106 and check == (start + sum(i * v for i, v in enumerate(body, 1))) % 103
    out, in_c = "", start == 105
    for v in body:
        if in_c and v == 100:
            in_c = False
        elif not in_c and v == 99:
            in_c = True
        else:
            out += f"{v:02d}" if in_c else chr(v + 32)
    return out


def test_code128_reads_back(spark):
    texts = ["A", "12", "1234", "12345", "A1234", "A12345B", "123456", "x 0007 y", "99999999z", "~ !", "1234A5678", "AB12CD3456"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", code128(F.col("t")).alias("v")).collect()
    assert [read_back(r["v"]) for r in got] == texts
    assert len(next(r["v"] for r in got if r["t"] == "123456")) == 6
    assert spark.createDataFrame([("é",), ("",)], "t string").select(code128(F.col("t"))).collect()[0][0] is None
