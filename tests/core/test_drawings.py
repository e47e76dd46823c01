"""Drawings, placed texts, backs of sheets, and folders that go away."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import drawings, faces, measure
from tallyframe.streaming import arrivals

SHAPE = "k int, kind string, a double, b double, c double, d double, points array<struct<x:double,y:double>>, w double, stroke string, fill string, page int"
NAN, INF = float("nan"), float("inf")


def test_bounds_and_faults_of_drawings(spark):
    rows = [
        (1, "line", 5.0, 9.0, 1.0, 20.0, None, 2.0, "#fff", None, 1), (2, "rect", 5.0, 9.0, -3.0, 4.0, None, 0.0, None, "#102030", 2), (3, "ellipse", 5.0, 9.0, -3.0, 4.0, None, 1.0, "#fff", None, 1),
        (4, "path", None, None, None, None, [(1.0, 2.0), (7.0, -1.0)], 0.0, "#fff", None, 1), (5, "path", None, None, None, None, [], 0.0, "#fff", None, 1), (6, "path", None, None, None, None, [(1.0, 1.0)], 0.0, "#fff", None, 1),
        (7, "line", NAN, 0.0, 1.0, 1.0, None, 1.0, "#fff", None, 1), (8, "line", 0.0, 0.0, INF, 1.0, None, 1.0, "#fff", None, 1), (9, "line", 0.0, 0.0, 1.0, 1.0, None, -1.0, "#fff", None, 1), (10, "line", 0.0, 0.0, 1.0, 1.0, None, 1.0, None, None, 1),
        (11, "line", 0.0, 0.0, 1.0, 1.0, None, 1.0, "#fff", "greenish", 1), (12, "line", 0.0, 0.0, 1.0, 1.0, None, NAN, "x", None, 0), (13, "line", 0.0, 0.0, 1.0, 1.0, None, 1.0, "#fff", None, 4),
    ]
    df = spark.createDataFrame(rows, SHAPE).withColumn("box", drawings.bounds(*[F.col(c) for c in ("kind", "a", "b", "c", "d", "points", "w")]))
    got = {r["k"]: r for r in df.withColumn("fault", drawings.drawing_fault(*[F.col(c) for c in ("kind", "box", "points", "w", "stroke", "fill", "page")], F.lit(3))).collect()}
    assert [tuple(got[k]["box"]) for k in (1, 2, 3, 4, 5)] == [(0.0, 8.0, 6.0, 21.0), (2.0, 9.0, 5.0, 13.0), (1.5, 4.5, 8.5, 13.5), (1.0, -1.0, 7.0, 2.0), (0.0, 0.0, 0.0, 0.0)]
    assert [got[k]["fault"] for k in range(1, 14)] == [None] * 4 + ["points", "points", "position", "position", "width", "nothing to see", "colour", "page", "page"]
    texts = spark.createDataFrame([(1.0, 1.0, 12.0, 1), (NAN, 1.0, 12.0, 1), (1.0, None, 12.0, 1), (1.0, 1.0, 0.0, 1), (1.0, 1.0, 4000.0, 3), (1.0, 1.0, 4000.1, 3), (1.0, 1.0, 9.0, 4)], "x double, y double, size double, page int")
    assert [r[0] for r in texts.select(drawings.text_fault(F.col("x"), F.col("y"), F.col("size"), F.col("page"), F.lit(3))).collect()] == [None, "position", "position", "size", None, "size", "page"]


def test_pages_of_sheets(spark):
    pages = spark.createDataFrame([(p,) for p in (0, 1, 2, 3, 8)], "p int")
    sheet, back = measure.sheet_and_back(F.col("p"))
    got = pages.select("p", sheet.alias("s"), back.alias("b"), measure.page_of(sheet, back).alias("again"), measure.sheets_for(F.col("p")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(0, 1, False, 1, 0), (1, 1, False, 1, 1), (2, 1, True, 2, 1), (3, 2, False, 3, 2), (8, 4, True, 8, 4)]
    t = pages.select(measure.turned(F.lit(10.0), F.lit(20.0), F.lit(90.0), F.lit(210.0), F.lit(297.0), F.col("p") > 1).alias("t")).collect()
    assert tuple(t[0]["t"]) == (10.0, 20.0, 90.0) and tuple(t[4]["t"]) == (200.0, 277.0, 270.0)


def test_words_worth_measuring(spark):
    words = ["ab", "a", "a1", "naïve", "ab.", "日本", "Żółw", "a b", "", "Œuvre", "€5", "²3"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"] for r in df.filter(faces.measurable(F.col("w"))).collect()} == {"ab", "a1", "naïve", "Œuvre", "²3"}


def test_a_folder_may_go_away_for_a_while(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_text("one")
    watched, handled, gone = arrivals.Folder(spark, str(tmp_path / "in"), f"{tmp_path}/state"), [], set(range(2, 11))
    listed, looks = watched.listing, iter(range(1, 100))

    def listing():
        if turn in gone:
            raise OSError("the share is away")
        return listed()

    def handle(todo):
        handled.append(todo.count())
        return todo.select("path", F.lit("done").alias("outcome"))

    monkeypatch.setattr(watched, "listing", listing)
    for turn in looks:
        watched.tolerant(turn, handle)
        if turn == 11:
            break
    assert handled == [0, 1] and watched.failed == 0  # nine failures are waited for; the look before them still counts
    gone |= set(range(20, 30))
    for turn in range(20, 29):
        assert watched.tolerant(turn, handle) is None
    turn = 29
    with pytest.raises(OSError, match="away"):
        watched.tolerant(turn, handle)
    assert arrivals.every() == "2 seconds" and arrivals.every(3600) == "3600 seconds"
    for seconds in (0, 3601):
        with pytest.raises(ValueError, match="apart"):
            arrivals.every(seconds)
