"""Merged pages, paired sheets, differences of ink, and sizes of lines, against plain versions."""

import math
import random

from pyspark.sql import functions as F

from tallyframe.operators import faces, pages


def test_merges_and_refusals(spark):
    files = [(1, 1, "a", "x"), (1, 2, "b", "y"), (1, 5, "c", "x"), (2, 1, "a", "x"), (3, 1, "a", "x"), (3, 2, "b", "z"), (4, 1, "a", "p"), (4, 2, "b", "q"), (5, 1, "a", "x"), (5, 2, "b", "x")]
    sheets = [(1, 1, 1, 595.0), (1, 1, 2, 595.0), (1, 2, 1, 595.9), (1, 5, 1, 594.5), (1, 5, 2, 595.0), (1, 5, 3, 300.0), (2, 1, 1, 595.0), (3, 1, 1, 595.0), (4, 1, 1, 595.0), (4, 1, 2, 595.0), (4, 2, 1, 595.0), (4, 2, 2, 597.0), (5, 1, 1, 595.0), (5, 2, 1, 595.0)]
    f = spark.createDataFrame(files, "job int, pos int, file string, digest string")
    p = spark.createDataFrame([(*s, 842.0, f"{s[1]}-{s[2]}") for s in sheets], "job int, pos int, page int, width double, height double, content string")
    put, refused, told = pages.merged(f, p)
    assert {tuple(r) for r in refused.collect()} == {(2, "too few", None, None, None), (3, "blank", None, None, 2), (4, "different paper", 2, 1, 2)}
    assert {(r["job"], r["page"], r["content"], r["width"]) for r in put.collect()} == {(1, 1, "1-1", 595.0), (1, 1, "2-1", 595.0), (1, 1, "5-1", 595.0), (1, 2, "1-2", 595.0), (1, 2, "5-2", 595.0), (1, 3, "5-3", 300.0), (5, 1, "1-1", 595.0), (5, 1, "2-1", 595.0)}
    assert {tuple(r) for r in told.collect()} == {(1, "a", 2, True, None), (1, "b", 1, True, None), (1, "c", 3, False, "a"), (5, "a", 1, False, None), (5, "b", 1, False, "a")}
    assert all(t.count() == 0 for t in pages.merged(f.limit(0), p.limit(0)))


def test_sheets_go_with_one_page_or_one_each(spark):
    sheets = spark.createDataFrame([(j, s) for j in (1, 2, 3, 4) for s in (1, 2, 3)], "job int, sheet int")
    have = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)], "job int, page int")
    got = {(r["job"], r["sheet"], r["page"], r["why"]) for r in pages.paired(sheets, have).collect()}
    assert got == {(1, s, 1, None) for s in (1, 2, 3)} | {(2, s, s, None) for s in (1, 2, 3)} | {(3, None, None, "3 sheets, 2 pages"), (4, None, None, "3 sheets, 0 pages")}


def test_differences_are_those_of_cells(spark):
    rng = random.Random(8)
    states = [{(p, rng.randrange(40), rng.randrange(25)) for p in (0, 1, 2) for _ in range(n)} | {(p, x, 7) for p in (0, 1) for x in range(30)} for n in (60, 140)]
    states[1] |= {(3, 1, 1)}
    sizes = [{0: (40, 25), 1: (30, 25), 2: (40, 25)}, {0: (40, 25), 1: (40, 20), 2: (35, 25), 3: (9, 9)}]
    runs = [pages.runs_of(spark.createDataFrame([*s], "page int, x int, y int")) for s in states]
    tables = [spark.createDataFrame([(p, *wh) for p, wh in s.items()], "page int, width int, height int") for s in sizes]
    for radius in (0, 1, 3):
        rows = pages.differences(*runs, radius, *tables).collect()
        got = [{(r["page"], x, r["y"]) for r in rows if r["side"] == side for x in range(r["x0"], r["x1"] + 1)} for side in ("removed", "added")]
        assert sum(r["x1"] - r["x0"] + 1 for r in rows) == sum(map(len, got))
        held = [{(p, x, y) for p, x, y in s if p in sizes[0] and p in sizes[1] and x < min(sizes[0][p][0], sizes[1][p][0]) and y < min(sizes[0][p][1], sizes[1][p][1])} for s in states]
        for mine, other, found in ((held[0], held[1], got[0]), (held[1], held[0], got[1])):
            near = {(p, x + i, y + j) for p, x, y in other for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)}
            assert found == mine - near
    wide = pages.grown_runs(spark.createDataFrame([(0, 0, 0, 100_000)], "page int, y int, x0 int, x1 int"), 50)
    assert wide.count() == 101  # not one for each cell


SHAPES = [("x", 0.7, 0.95), ("l", 1.05, 0.25), ("T", 1.0, 0.85), ("i", 0.97, 0.22)]


def plain(heights, forms, passes):
    def best(h, f):
        off, glyph, tall = min((abs(h - t) + abs(f - o), g, t) for g, t, o in SHAPES)
        return glyph, math.exp(-((off / 0.2) ** 2)), tall

    capital = sorted(heights)[3 * len(heights) // 4] / 1.05
    for n in range(passes):
        found = [best(h / capital, f) for h, f in zip(heights, forms, strict=True)]
        says = sorted(h / t for h, (_, sure, t) in zip(heights, found, strict=True) if sure >= 0.7)
        if n + 1 == passes or len(says) < 3 or abs(says[len(says) // 2] - capital) / capital < 0.02:
            return [g for g, _, _ in found], capital
        capital = says[len(says) // 2]


def test_lines_are_read_at_the_size_they_turn_out_to_have(spark):
    rng = random.Random(1)
    lines = {}
    for n in range(30):
        own = rng.sample(SHAPES, rng.choice([1, 2, 4]))
        letters = [rng.choice(own) for _ in range(rng.choice([2, 5, 30]))]
        lines[n] = ([t * (1 + n % 4) * rng.uniform(0.98, 1.02) for _, t, _ in letters], [o + rng.uniform(-0.03, 0.03) for _, _, o in letters])
    rows = [(n, i, h, f) for n, (hs, fs) in lines.items() for i, (h, f) in enumerate(zip(hs, fs, strict=True))]
    df = spark.createDataFrame(rows, "line int, i int, h double, f double").repartition(4)
    answers = []
    for passes in (1, 2, 4):
        got = {(r["line"], r["i"]): (r["glyph"], r["capital"]) for r in faces.scaled_lines(df, "line", "h", "f", SHAPES, 1.05, passes).collect()}
        for n, (hs, fs) in lines.items():
            glyphs, capital = plain(hs, fs, passes)
            assert [got[n, i][0] for i in range(len(hs))] == glyphs and abs(got[n, 0][1] - capital) < 1e-9
        answers.append({k: g for k, (g, _) in got.items()})
    assert answers[0] != answers[1]  # the second pass reads some letters otherwise
    assert faces.scaled_lines(df.filter(F.col("line") < 0), "line", "h", "f", SHAPES, 1.05).count() == 0
