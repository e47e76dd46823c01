"""What SQL can't say, or what the tables don't hold: edges, hostile texts, sequences of steps."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import measure, template, text
from tallyframe.operators import extract, fits, greedy, islands, rank, rules, sequence, sets, spatial
from tallyframe.sources import files, lists
from tallyframe.streaming import arrivals

HOSTILE = ["", " ", "\n", "{", "}", "{}", "{{a}}", "\u0000", "🙂" * 5, "á", "İ", "'; drop table x", "%s%n", "\\", '"', "1" * 400, "‮", "nan", "-0", "{a{b}"]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("value", HOSTILE)
def test_no_text_breaks_a_function(spark, value):
    c = F.col("x")
    columns = [text.squash(c), text.shape(c), text.budget(c), text.is_number(c), text.repair_digits(c), text.shorten_tail(c, 5), text.safe_name(c, "f"), text.valid_name(c), text.wrapped(c, 4), text.script(c), template.placeholders(c), measure.sheet_size(c), measure.colour(c)]
    assert spark.createDataFrame([(value,)], "x string").select(*[k.alias(f"c{i}") for i, k in enumerate(columns)]).count() == 1


@pytest.mark.parametrize(("value", "want"), [("2O24", "2024"), ("B2B", "B2B"), ("5OO l", "500 l"), ("", ""), ("Oil", "Oil"), ("I0-l", "10-1")])
def test_digits_are_repaired_where_they_belong(spark, value, want):
    assert one(spark, value, text.repair_digits) == want


@pytest.mark.parametrize(("value", "want"), [("5.", True), (".5", True), ("1d", False), ("1_0", False), ("", False), ("+", False), ("£1,200", True), ("1e", False), ("Infinity", True), ("0x10", False)])
def test_numbers_are_told_by_their_shape(spark, value, want):
    assert one(spark, value, text.is_number) is want


def test_templates_are_not_filled_again(spark):
    df = spark.createDataFrame([("{number}", 3)], "a string, number int")
    fill = lambda t: df.select(template.fill(t, ["a"])).first()[0]
    assert fill("{a}-{number}-{b}-{") == "{number}-3-{b}-{"
    assert fill("{a{b}") == "{a{b}" and fill("") == "" and fill("}{a}") == "}{number}"
    assert template.unknown_columns(["{a}{z}{number}", "{z}{y}"], df) == ["z", "y"]


def test_field_specs():
    assert template.field_spec("Total=Sum due/below/number") == {"name": "Total", "label": "Sum due", "place": "below", "number": True}
    assert template.field_spec("A/after/below")["place"] == "after"
    with pytest.raises(ValueError):
        template.field_spec("/number")


@pytest.mark.parametrize(("serial", "want"), [(0.5, "12:00:00"), (1.0, "1900-01-01"), (59.0, "1900-02-28"), (60.0, "1900-02-28"), (61.0, "1900-03-01"), (45487.0, "2024-07-14"), (1.999999, "1900-01-01 24:00:00"), (-1.0, None)])
def test_serial_dates(spark, serial, want):
    assert spark.createDataFrame([(serial,)], "x double").select(measure.serial_date(F.col("x"))).first()[0] == want


def test_roman_and_letters(spark):
    got = spark.createDataFrame([(n,) for n in (1, 4, 9, 14, 40, 90, 400, 1994, 3999, 9000)], "n int").select(measure.roman(F.col("n"))).collect()
    assert [r[0] for r in got] == ["I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", "MMMCMXCIX", "MMMCMXCIX"]
    got = spark.createDataFrame([(n,) for n in (1, 26, 27, 52, 702)], "n int").select(measure.letters(F.col("n"))).collect()
    assert [r[0] for r in got] == ["a", "z", "aa", "az", "zz"]


def test_wrapping_keeps_words(spark):
    assert one(spark, "a bb  ccc dddddd e", lambda c: text.wrapped(c, 5)) == ["a bb", "ccc", "dddddd", "e"]
    assert one(spark, " ", lambda c: text.wrapped(c, 5)) == []


def test_vectors_that_cannot_be_compared_are_far(spark):
    df = spark.createDataFrame([([1.0, 1.0], [1.0]), ([0.0], [0.0]), ([1.0, 0.0], [0.0, 2.0]), ([2.0, 2.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(measure.half_l1(F.col("a"), F.col("b"))).collect()] == [float("inf"), float("inf"), 1.0, 0.0]


def test_membership_keeps_repeated_rows(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x")], "k int, v string")
    assert sorted(map(tuple, sets.added_since(a, spark.createDataFrame([(1, None)], a.schema)).collect())) == [(2, "x"), (2, "x")]


def test_duplicates_of_no_columns_and_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "")], "n long, v string")
    assert sets.duplicate_groups(df, [], "n").count() == 0
    assert [tuple(r) for r in sets.duplicate_groups(df, ["v"], "n").collect()] == [(1, 2, [1, 2])]


def test_config_is_kept_or_replaced(spark):
    mine, theirs = (spark.createDataFrame(r, "k string, v int") for r in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    assert {r["k"]: (r["v"], r["outcome"]) for r in sets.merge_config(mine, theirs, "k", "v", replace=False).collect()} == {"a": (1, "same"), "b": (2, "kept"), "c": (4, "added")}


def test_tolerance_is_inclusive_and_distinct_is_greedy(spark):
    df = spark.createDataFrame([("g", i, x, 0.0) for i, x in enumerate([0.0, 0.5, 1.0, 1.01])], "g string, i long, x double, y double")
    assert [r["i"] for r in greedy.distinct_shapes(df, "g", "i", ["x", "y"], 0.5).orderBy("i").collect()] == [0, 2]


@pytest.mark.parametrize(("numbers", "said"), [([3], "3"), ([3, 4], "3 and 4"), ([1, 2, 3], "1 to 3"), ([1, 3, 4], "1, 3 and 4"), ([1, 2, 3, 7, 9, 10], "1 to 3, 7, 9 and 10")])
def test_runs_in_words(spark, numbers, said):
    assert islands.compacted(spark.createDataFrame([(1, n) for n in numbers], "g int, n int"), ["g"], "n").first()["said"] == said


def test_counters_start_anew_below_a_heading(spark):
    levels = [1, 2, 2, 1, 2, 3, 3, 2, 3]
    df = spark.createDataFrame([("d", i, lv) for i, lv in enumerate(levels)], "d string, i int, lv int")
    got = [r["numbers"] for r in islands.hierarchical_numbers(df, "d", "i", "lv", 3).orderBy("i").collect()]
    assert got == ["1", "1.1", "1.2", "2", "2.1", "2.1.1", "2.1.2", "2.2", "2.2.1"]


def test_numbers_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    assert all(r["number"] == r["k"] + 1 for r in sequence.numbered(df, "k").collect())


def test_a_similarity_is_recovered(spark):
    rng, centre = np.random.default_rng(1), (105.0, 148.5)
    fit = {"rotation": F.lit(1.7), "scale": F.lit(1.013), "dx": F.lit(2.0), "dy": F.lit(-3.5)}
    pts = spark.createDataFrame([(1, float(x), float(y)) for x, y in rng.uniform(0, 200, (30, 2))], "g int, ax double, ay double")
    bx, by = measure.apply_similarity(F.col("ax"), F.col("ay"), fit, centre)
    got = fits.similarity(pts.select("g", "ax", "ay", bx.alias("bx"), by.alias("b_y")), ["g"], centre, "ax", "ay", "bx", "b_y").first()
    assert [round(got[c], 6) for c in ("rotation", "scale", "dx", "dy", "rms")] == [1.7, 1.013, 2.0, -3.5, 0.0]
    same = spark.createDataFrame([(1, 5.0, 5.0, 6.0, 6.0)] * 3, "g int, ax double, ay double, bx double, b_y double")
    assert fits.similarity(same, ["g"], centre, "ax", "ay", "bx", "b_y").count() == 0


def test_outliers_do_not_bend_a_robust_line(spark):
    pts = [(1, float(x), 3.0 * x + 1 + (0.01 if x % 2 else -0.01)) for x in range(30)] + [(1, 5.0, 500.0), (1, 9.0, -400.0)]
    df = spark.createDataFrame(pts, "g int, x double, y double")
    plain, robust = fits.line(df, ["g"], "x", "y").first(), fits.robust_line(df, ["g"], "x", "y").first()
    assert abs(robust["slope"] - 3) < 0.01 < abs(plain["slope"] - 3) and robust["n"] == 30


def test_otsu_of_nothing_and_of_two_peaks(spark):
    none = spark.createDataFrame([(i, 0) for i in range(256)], "level int, n long")
    assert fits.otsu(none).first()[0] == 128
    two = spark.createDataFrame([(i, 100 if i in (50, 200) else 0) for i in range(256)], "level int, n long")
    assert fits.otsu(two).first()[0] == (50 + 199) // 2


def test_matches_need_a_lead(spark):
    ranked = spark.createDataFrame([(1, 10, 0.1, 1), (1, 11, 0.15, 2), (2, 10, 0.1, 1), (2, 11, 0.3, 2), (3, 10, 0.2, 1), (4, 10, 0.31, 1)], "sheet long, candidate long, distance double, rank int")
    assert {r["sheet"]: r["sure"] for r in rank.confident(ranked, "sheet", "distance").collect()} == {1: False, 2: True, 3: True, 4: False}


def test_near_ties_go_to_the_earlier(spark):
    df = spark.createDataFrame([([(1.0, "a"), (1.01, "b"), (1.05, "c")],)], "l array<struct<score:double,name:string>>")
    assert df.select(rank.near_tie(F.col("l"))).first()[0] == "c"


def test_boxes_merge_to_the_end(spark):
    boxes = [("p", 1, 0.0, 0.0, 4.0, 4.0), ("p", 2, 3.0, 0.0, 8.0, 2.0), ("p", 3, 7.0, 1.0, 9.0, 9.0), ("p", 4, 20.0, 20.0, 21.0, 21.0), ("q", 5, 0.0, 0.0, 4.0, 4.0)]
    got = spatial.merged_boxes(spark.createDataFrame(boxes, "p string, id int, x0 double, y0 double, x1 double, y1 double"), "p", 5.0).collect()
    assert sorted((r["p"], r["id"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got) == [("p", 1, 0, 0, 9, 9), ("p", 4, 20, 20, 21, 21), ("q", 5, 0, 0, 4, 4)]


def test_regions_join_over_corners(spark):
    snake = [(1, x, x) for x in range(60)] + [(1, 100, 3)]
    got = spatial.regions(spark.createDataFrame(snake, "p int, x int, y int"), "p", 1).collect()
    assert sorted((r["x0"], r["x1"], r["n"]) for r in got) == [(0, 59, 60), (100, 100, 1)]


def test_anchors(spark):
    docs = spark.createDataFrame([(1, "total due: 5\nother"), (2, "Total\nTotal"), (3, "Totel due"), (4, "nothing")], "k int, t string")
    got = {r["sheet"]: (r["status"], r["n"]) for r in extract.resolve_anchor(extract.placed_words(docs, "k", "t"), "Total due").collect()}
    assert got == {1: ("Found", 1), 2: ("NotFound", 0), 3: ("Found", 1), 4: ("NotFound", 0)}


def test_swapped_documents_hide_moved_content_only(spark):
    checks = spark.createDataFrame([("blocker", "documents_reversed", 0, None), ("blocker", "reflow", 1, None), ("warning", "large_delta", 1, None)], "severity string, code string, page long, detail string")
    assert sorted(r["code"] for r in rules.without_symptoms(checks).collect()) == ["documents_reversed", "large_delta"]
    assert rules.without_symptoms(checks.filter("page = 1")).count() == 2
    assert tuple(rules.verdict(checks.filter("page = 1")).first()) == (True, True) and tuple(rules.verdict(checks.limit(0)).first()) == (False, True)


# --- lists and files -------------------------------------------------------------------------------------------------


def put(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return path


def test_lists_are_read_strictly(spark, tmp_path):
    good = put(tmp_path, "a.csv", '﻿name , address\r\nAnn,"1, High St\nTown ""X"""\r\n\r\n Bob ,\r\n')
    assert [tuple(r) for r in lists.read_list(spark, good).orderBy("number").collect()] == [(1, "Ann", '1, High St\nTown "X"'), (2, "Bob", "")]
    odd = put(tmp_path, "odd.csv", 'a,b\r1"x"y,"p\rq"\r"""",""\r2,"never closed, so\nall of it\r3')
    assert [tuple(r)[1:] for r in lists.read_list(spark, odd).orderBy("number").collect()] == [("1xy", "p\rq"), ('"', ""), ("2", "never closed, so\nall of it\r3")]
    (tmp_path / "many").mkdir()
    for n in range(3):
        put(tmp_path / "many", f"{n}.csv", "k,v\n" + "".join(f"{n},{i}\n" for i in range(n + 1)))
    assert [tuple(r) for r in lists.read_list(spark, str(tmp_path / "many")).orderBy("number").collect()] == [(1, "0", "0"), (2, "1", "0"), (3, "1", "1"), (4, "2", "0"), (5, "2", "1"), (6, "2", "2")]
    put(tmp_path / "many", "9.csv", "k,w\n1,2\n")
    with pytest.raises(lists.ListError, match="another header"):
        lists.read_list(spark, str(tmp_path / "many"))
    for name, data in (("b.csv", "a,b\n1,2,3\n"), ("c.csv", "a,b\n1\n"), ("d.csv", "a,b\n"), ("e.csv", ",\n1,2\n"), ("f.csv", b"a\n\xff\xfe\n")):
        with pytest.raises(lists.ListError):
            lists.read_list(spark, put(tmp_path, name, data))
    with pytest.raises(lists.ListError):
        lists.counted(spark, 50_001)


def test_reports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", ""), ('say "x"', "line\nline")], "p string, q string")
    lists.write_report(df.coalesce(1), f"{tmp_path}/out")
    back = spark.read.options(header=True, multiLine=True, quote='"', escape='"', emptyValue="", nullValue="\u0000").csv(f"{tmp_path}/out")
    assert sorted(map(tuple, back.na.fill("").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        files.refuse_to_clobber(f"{tmp_path}/out/", [f"file:{tmp_path}/out"])


def test_damaged_log_entries_are_left_out(spark, tmp_path):
    path = put(tmp_path, "log.jsonl", '{"at": 1, "source": "a"}\n\nnot json\n{"at": 2}\n{"at": 3, "source": "b"}\n')
    assert sorted(r["at"] for r in lists.read_log(spark, path, "at long, source string", ["at", "source"]).collect()) == [1, 3]


def test_files_are_told_by_content(spark, tmp_path):
    for name, data in (("a.txt", "words"), ("b.txt", b"%PDF-1.7"), ("c.csv", b"PK\x03\x04zip"), ("d.txt", b"\xff\xfe\xfd")):
        put(tmp_path, name, data)
    got = {os.path.basename(r["path"]): (r["kind"], r["text"]) for r in files.documents_in(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("text", "words"), "b.txt": ("pdf", None), "c.csv": ("zip", None), "d.txt": ("unknown", None)}


def test_series_advance_only_from_where_they_were_read(spark, tmp_path):
    a, b = (sequence.SeriesCounters(spark, f"{tmp_path}/series") for _ in range(2))
    assert a.start("inv") == 1
    a.reached("inv", 1, 11)
    assert b.start("inv") == 11
    with pytest.raises(sequence.Moved):
        b.reached("inv", 1, 5)
    b.reached("inv", 11, 11)  # nothing written, nothing advanced
    b.reached("other", 1, 4)
    assert a.all() == {"inv": 11, "other": 4}


def test_a_file_is_handled_once_and_again_when_written_anew(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.pdf", "one")
    put(folder, "empty.pdf", "")
    sweeps = arrivals.Folder(spark, str(folder), f"{tmp_path}/state")
    handled = []

    def handle(todo):
        handled.append(sorted(os.path.basename(r["path"]) for r in todo.collect()))
        return todo.select("path", F.lit("done").alias("outcome"))

    def verdicts(turn):
        return {os.path.basename(r["path"]): r["verdict"] for r in sweeps.sweep(turn, handle).collect()}

    assert verdicts(1) == {"a.pdf": "arriving"}  # Spark doesn't list empty files, which can't be settled anyway
    verdicts(2)
    verdicts(2)  # a turn that is run again does the same work and writes over its own entries
    verdicts(3)
    put(folder, "a.pdf", "longer than before")
    verdicts(4)
    verdicts(5)
    assert handled == [[], ["a.pdf"], ["a.pdf"], [], [], ["a.pdf"]]


def test_looks_are_followed_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.pdf", "one")
    put(folder, "b.pdf", "x")
    watched, handled = arrivals.Folder(spark, str(folder), f"{tmp_path}/state"), []

    def handle(todo):
        names = sorted(os.path.basename(r["path"]) for r in todo.collect())
        handled.append(names)
        return todo.select("path", F.lit("done").alias("outcome"))

    for turn, change in enumerate((None, ("b.pdf", "xx"), None, ("a.pdf", "one more"), None, None), 1):
        if change:
            put(folder, *change)
        watched.look(turn)
        watched.follow(handle).awaitTermination()
    assert [h for h in handled if h] == [["a.pdf"], ["b.pdf"], ["a.pdf"]]
    assert {(os.path.basename(r["path"]), r["size"], r["at"]) for r in watched.handled().collect()} == {("a.pdf", 3, 2), ("b.pdf", 2, 3), ("a.pdf", 8, 5)}
    # Several looks in one batch are taken in their order.
    late = arrivals.Folder(spark, str(folder), f"{tmp_path}/late")
    for turn in (1, 2, 3):
        late.look(turn)
    late.follow(handle).awaitTermination()
    assert sorted((os.path.basename(r["path"]), r["at"]) for r in late.handled().collect()) == [("a.pdf", 2), ("b.pdf", 2)]


def test_a_watch_is_a_streaming_query(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.pdf", "one")
    done = []
    handle = lambda todo: done.extend(r["path"] for r in todo.collect()) or todo.select("path", F.lit("done").alias("outcome"))
    stream = arrivals.Folder(spark, str(folder), f"{tmp_path}/state").watch(handle, every="500 milliseconds")
    import time

    until = time.time() + 60
    while not done and time.time() < until and stream.isActive:
        time.sleep(0.5)
    stream.stop()
    assert len(done) == 1


def test_ledgers_are_cut_down(spark):
    ledger = spark.createDataFrame([(f"p{i}", i, "done") for i in range(20)] + [("p1", 99, "failed")], "path string, at int, outcome string")
    present = spark.createDataFrame([("p1",), ("p2",)], "path string")
    got = {r["path"]: r["at"] for r in arrivals.compacted(ledger, present, most=8).collect()}
    assert got == {"p1": 99, "p2": 2, "p19": 19, "p18": 18, "p17": 17}


def test_common_runs_are_as_long_as_they_are(spark):
    def brute(a, b):
        return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)

    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(40))
    pairs = [(long, f"x{long}y"), (long[:13], long), (long[5:45], f"{long[3:50]}z"), ("", "a"), ("", ""), ("abc", "xyz"), ("aab", "baa"), ("a" * 30, "a" * 29 + "b"), ("é😀x" * 7, "😀xé" * 9)]
    table = spark.createDataFrame([*pairs, (None, "a")], "a string, b string")
    got = {(r["a"], r["b"]): r["run"] for r in table.select("a", "b", text.common_run(F.col("a"), F.col("b")).alias("run")).collect()}
    assert got == {(a, b): brute(a, b) for a, b in pairs} | {(None, "a"): 0}


def test_suggestions_rank_lines_by_runs_over_twelve_letters(spark):
    said = "abcdefghijklmnopqrstuvwxyz0123456789"
    forms = spark.createDataFrame([(1, "\n".join([said[:12], said[:20], said]))], "id long, form string")
    got = [(r["said"], r["run"]) for r in extract.suggestions(extract.placed_words(forms, "id", "form"), said).collect()]
    assert got == [(said, 36), (said[:20], 20), (said[:12], 12)]


def test_styles_come_from_any_ancestor(spark, tmp_path):
    from tallyframe.plans import catalogue

    # The nearest styled ancestor of the last key is eight levels up.
    chain = [3]
    while len(chain) < 9:
        chain.append(next(k for k in (10 * chain[-1] + 1, 10 * chain[-1] + 2) if k % 3))
    spark.createDataFrame([(k, f"b{k}") for k in chain], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r["p_partkey"]: r["style"] for r in catalogue.QUERIES["inherited_styles"](spark, str(tmp_path)).collect()} == dict.fromkeys(chain, "b3")
