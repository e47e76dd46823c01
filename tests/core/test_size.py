"""Steps whose work must follow their input."""

import glob
import random
import time

from pyspark.sql import functions as F

from tallyframe.functions import faces, text
from tallyframe.operators import checks, extract, fits, marks, pages, scan, spatial, tables
from tallyframe.operators import faces as lines
from tallyframe.sources import lists


def test_a_list_of_many_quotes_is_read_in_one_pass(spark):
    content = "key,note\n" + "".join(f'{i},"a ""b"", c"\n' for i in range(20_000)) + '1,""'
    start = time.time()
    got = lists.records(spark.createDataFrame([("p", content)], "path string, content string"))
    last = got.filter("at >= 20000").orderBy("at").collect()
    assert [r["cells"] for r in last] == [["19999", 'a "b", c'], ["1", ""]]
    assert time.time() - start < 60


def test_reports_are_parted_into_files_of_bounded_rows(spark, tmp_path):
    df = spark.range(25).coalesce(1).selectExpr("id AS key", "concat('a \"', id, '\"\\nb') AS note")
    lists.write_report(df, f"{tmp_path}/out", 10)
    assert len(glob.glob(f"{tmp_path}/out/*.csv")) == 3
    got = lists.read_list(spark, f"{tmp_path}/out/*.csv").orderBy("number").collect()
    assert [tuple(r) for r in got] == [(i + 1, str(i), f'a "{i}"\nb') for i in range(25)]


def boxes_of_one_place(spark, n):
    return spark.range(n).coalesce(1).selectExpr("id", "id % 1 AS page", "cast(id % 7 AS double) AS x0", "20.0D AS y0", "cast(id % 7 + 3 AS double) AS x1", "30.0D AS y1")


def test_pairs_of_one_place_are_made_by_several_tasks(spark):
    boxes = boxes_of_one_place(spark, 300)
    pairs = spatial.overlapping(boxes, boxes, "page", 64.0)
    want = boxes.alias("a").join(boxes.alias("b"), F.expr("a.x0 < b.x1 AND b.x0 < a.x1")).select("a.page", "a.id", "b.id")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, want.collect()))
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_boxes_that_are_alike_are_looked_at_once(spark):
    """Seven different boxes among 100,000, and as many cells that come again: pairs of all would be ten milliards."""
    n = 100_000
    boxes, ink = boxes_of_one_place(spark, n), spark.range(n).selectExpr("id % 1 AS page", "id % 3 AS x", "13 + id % 3 AS y")
    cells = {(i, 13 + i) for i in range(3)}
    start = time.time()
    for found, want in (
        (spatial.clear_above(boxes, ink, "page", 8.0), lambda x: min([20.0 - b for a, b in cells if x <= a < x + 3 and 20 - b <= 8], default=8.0)),
        (spatial.nearest_ink(boxes, ink, "page", 25), lambda x: min([max(x - a, a - x - 3, 20 - b, b - 30, 0) for a, b in cells])),
    ):
        assert {tuple(r) for r in found.collect()} == {(i, want(i % 7)) for i in range(n)}
    assert time.time() - start < 60


def test_scripts_of_a_text_of_many_blocks(spark):
    """1,500 blocks of code points, twenty letters of each, and words of three scripts that are listed."""
    body = "".join(chr(0x40000 + 128 * p + i) for i in range(20) for p in range(1_500)) + "abc абв? α"
    start = time.time()
    got = {r["s"]["script"]: r["s"]["n"] for r in spark.createDataFrame([(body,)], "t string").select(F.explode(text.script_counts(F.col("t"))).alias("s")).collect()}
    assert got == {"Latin": 3, "Cyrillic": 3, "Greek": 1} | {f"Elsewhere {(0x40000 >> 7) + p}": 20 for p in range(1_500)}
    assert time.time() - start < 30


def test_marks_of_one_page_meet_the_bases_about_them_only(spark):
    """100,000 marks on a page, among which every mark may belong to some hundred bases."""
    df = spark.range(100_000).coalesce(1).selectExpr("id", "0 AS page", "cast(id * 37 % 500 AS double) AS x", "cast(id * 91 % 300 AS double) AS y", "2 + cast(id * 7 % 13 AS double) AS w", "1 + cast(id * 11 % 29 AS double) * cast(id * 5 % 7 AS double) / 4 AS h")
    start = time.time()
    assert marks.owned(df, "page", 32.0).filter("owner IS NOT NULL").count() > 20_000
    assert time.time() - start < 100


def test_marks_get_the_base_that_a_comparison_with_all_gives(spark):
    rng = random.Random(6)
    rows = [(i % 2, i, rng.choice([rng.uniform(0, 60), float(rng.randrange(60))]), float(rng.randrange(40)), rng.choice([0.0, 2.0, rng.uniform(1, 30)]), rng.choice([0.0, 1.0, 2.0, 20.0, rng.uniform(1, 200)])) for i in range(400)] + [(0, 900, None, 1.0, 1.0, 1.0), (None, 901, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows + [(*r[:1], r[1] + 1000, *r[2:]) for r in rows[:50]], "page int, id int, x double, y double, w double, h double").repartition(3)
    placed = df.dropna()  # a mark without a place belongs to none and owns none
    pairs = placed.select(*[F.col(c).alias(f"b{c}") for c in df.columns]).join(placed.select(*[F.col(c).alias(f"m{c}") for c in df.columns]), F.expr("bpage = mpage AND bid <> mid")).filter(marks.belongs("b", "m"))
    want = {r["mid"]: r["best"][2] for r in pairs.groupBy("mid").agg(F.expr("min(struct(abs(bx + bw / 2 - mx - mw / 2) AS a, -bh AS h, bid)) AS best")).collect()}
    for width in (0.3, 32.0):
        got = df.join(marks.nearest_bases(df, "page", width), ["page", "x", "y", "w", "h"]).filter("owner IS NOT NULL")
        assert {r["id"]: r["owner"] for r in got.collect()} == want and len(want) > 50
    assert marks.owned(df.limit(0), "page", 32.0).count() == 0


def test_elements_of_one_group_are_looked_for_together(spark):
    """Rows are read once for all elements that lie between the same bounds, not once for each."""
    df = spark.range(40_000).selectExpr("id % 100 AS g", "cast(hash(id) AS double) AS x")
    got = fits.indexed_quantiles(df, ["g"], "x")
    wants = {r["g"]: r["v"] for r in df.groupBy("g").agg(F.sort_array(F.collect_list("x")).alias("v")).collect()}
    assert {r["g"]: (r["lower"], r["median"], r["upper"]) for r in got.collect()} == {g: (v[len(v) // 4], v[len(v) // 2], v[3 * len(v) // 4]) for g, v in wants.items()}
    met: list = []

    def joined(frame, *args, **kwargs):
        out = real(frame, *args, **kwargs)
        met.append(out.count() if "__x" in out.columns else 0)
        return out

    real, kind = type(df).join, type(df)
    kind.join = joined
    try:
        fits.indexed_quantiles(df, ["g"], "x")
    finally:
        kind.join = real
    assert max(met) == 40_000


def test_only_words_of_a_phrase_are_laid_beside_each_other(spark):
    """Words that stand nowhere in a phrase get no frame; still none of them is passed over."""
    lines = ["it was the best", "it was not the best", "it - was, the BEST", "i t w a s t h e b e s t", "it was it was the best it was the best", "it wasthe best", "xit was the best", "it was the bests", ("other words " * 500) + "it was the best"]
    words = extract.placed_words(spark.createDataFrame(list(enumerate(lines)), "sheet int, t string"), "sheet", "t")
    got = sorted((r["sheet"], r["first"], r["last"]) for r in extract.phrase_hits(words, "It was the best", 0).collect())
    assert got == [(0, 0, 3), (2, 0, 4), (3, 0, 11), (4, 2, 5), (4, 6, 9), (5, 0, 2), (8, 1000, 1003)]
    assert extract.keyed(words.filter("sheet = 8"), 12, "itwasthebest").count() == 4


def dealt_out(df):
    return df.rdd.getNumPartitions() >= 10


def jobs_of_one_page(spark):
    """1,000 jobs, each with ink gone from its one page; of every second one nothing is new."""
    jobs = spark.range(1000).selectExpr("id AS job", "if(id % 3 = 0, 'p', null) AS profile")
    page = jobs.selectExpr("job", "1L AS page", "210.0D AS width", "297.0D AS height")
    return jobs, page, page, jobs.filter("job % 2 = 0").selectExpr("job", "1L AS page", "50.0D AS x0", "50.0D AS y0", "60.0D AS x1", "60.0D AS y1", "3.0D AS ink"), jobs.selectExpr("job", "1L AS page", "20.0D AS y0", "2.0D AS ink")


def test_verdicts_are_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100, raising=False)
    jobs, *rest = jobs_of_one_page(spark)
    got = checks.verdicts(jobs, checks.everything(jobs, *rest))
    assert {tuple(r) for r in got.collect()} == {(j, True, j % 2 == 0) for j in range(1000)} and dealt_out(got)


def test_merged_pages_are_dealt_out_by_rows(spark, monkeypatch):
    """One job of 600 files, of which two are alike, and 200 jobs of two files, every fourth of them on different paper."""
    monkeypatch.setattr(tables, "ROWS", 20, raising=False)
    files = spark.range(1000).selectExpr("if(id < 600, -1L, id div 2) AS job", "id AS pos", "concat('f', id) AS file", "if(id = 7, 3L, id) AS digest")
    sides = files.selectExpr("job", "pos", "1 AS page", "if(job % 4 = 0 AND pos % 2 = 1, 300.0D, 210.0D) AS width", "297.0D AS height", "pos AS content")
    put, refused, told = pages.merged(files, sides)
    bad = set(range(300, 500, 4))
    assert {(r["job"], r["why"]) for r in refused.collect()} == {(j, "different paper") for j in bad}
    assert {r["pos"] for r in put.collect()} == {i for i in range(1000) if i < 600 or i // 2 not in bad}
    assert {r["file"]: r["same_as"] for r in told.collect()} == {f"f{i}": "f3" if i == 7 else None for i in range(1000) if i < 600 or i // 2 not in bad}
    assert all(map(dealt_out, (put, refused, told)))


def test_marks_are_matched_once_in_a_pass(spark, monkeypatch):
    """What sure marks say is a table before anything is counted."""
    marks_of = spark.range(700).selectExpr("id", "id % 7 AS line", "2.0D + id % 5 AS h", "0.5D AS form")
    seen, real = [], fits.elements
    monkeypatch.setattr(fits, "elements", lambda df, *args: seen.append(df) or real(df, *args))
    assert lines.scaled_lines(marks_of, "line", "h", "form", [("x", 0.7, 0.5), ("T", 1.0, 0.5)], 1.05).count() == 700
    assert len(seen) == 2 and hasattr(seen[1], "written_to")


def test_places_are_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100, raising=False)
    got = scan.placed(spark.range(1000).selectExpr("id % 3 AS g", "id AS o"), ["g"], ["o"])
    assert {(r["o"], r["place"]) for r in got.collect()} == {(i, i // 3 + 1) for i in range(1000)} and dealt_out(got)


def test_moved_pages_of_jobs_are_counted_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100, raising=False)
    found = checks.everything(*jobs_of_one_page(spark)).filter("code = 'reflow'")
    got = checks.split(found)
    assert {(r["job"], r["code"], r["detail"]) for r in got.collect()} == {(j, "reflow_split", 1.0) for j in range(1000)} and dealt_out(got.filter("code = 'reflow_split'"))


def test_symptoms_are_left_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100, raising=False)
    got = checks.without_symptoms(checks.everything(*jobs_of_one_page(spark))).filter("code = 'reflow'")
    assert {r["job"] for r in got.collect()} == set(range(0, 1000, 2)) and dealt_out(got)
