"""Typefaces and what they can write, against truth that the tests make."""

from pyspark.sql import functions as F

from tallyframe.functions import faces, measure
from tallyframe.operators import faces as pages
from tallyframe.operators import extract, spatial
from tallyframe.plans.faces import FACES


def test_encoding_agrees_with_the_code_page(spark):
    texts = ["plain", "café €", "„so“\tit\r\nis", "→ λ →", "bell\x07→", "", "\x85", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(*faces.encoded(F.col("t")), faces.missing(F.col("t"))).collect()
    for text, (status, held, gone) in zip(texts, got, strict=True):
        if status == "Encoded":
            assert bytes(held) == text.replace("\t", " ").replace("\r", "").replace("\n", "").encode("cp1252")
        else:
            assert held is None
    assert [r[0] for r in got] == ["Encoded", "Encoded", "Encoded", "Missing", "Control", "Encoded", "Missing", None]
    assert got[3][2] == ["→", "λ"]


def test_width_is_the_sum_of_characters(spark):
    widths = {"a": 500, "]": 278, "^": 469, "-": 333, " ": 278, "\\": 278}
    texts = ["a-a", "]^\\", "a\ta", "zzz", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(faces.width_mm(F.col("t"), widths, 10.0)).collect()]
    for text, width in zip(texts, got, strict=True):
        assert abs(width - sum(widths.get(c, 0) for c in text.replace("\t", " ")) / 1000 * 10 * 25.4 / 72) < 1e-12


def test_the_face_of_a_page_is_found(spark):
    words = "Invoice number total amount Wednesday illicit Mississippi William Orders Quantity shipped minimum".split()
    rows = [(name, w, (i + 9) * sum(table[c] for c in w) / 1000 * 25.4 / 72 + 0.1 + (40.0 if k == 3 else 0.0)) for i, (name, table) in enumerate(FACES.items()) for k, w in enumerate(words)]
    rows += [("two words", "one", 5.0), ("two words", "two", 5.0), ("marks", "--", 3.0)]
    same = FACES | {"Sans again": FACES["Sans"]}
    got = {r["page"]: r for r in pages.typefaces(spark.createDataFrame(rows, "page string, text string, width double"), "page", same).collect()}
    assert set(got) == set(FACES)
    for i, name in enumerate(FACES):
        assert (got[name]["face"], round(got[name]["size_pt"], 6)) == (name, i + 9)
        assert got[name]["words"] == len(words) - 1 and got[name]["confidence"] > 0.9  # the word that is 40 mm off is left out
    assert pages.typefaces(spark.createDataFrame([], "page string, text string, width double"), "page", FACES).count() == 0


def test_pictures_move_without_wrapping(spark):
    v = [float(i) for i in range(9)]
    got = spark.createDataFrame([(v,)], "v array<double>").select(*[measure.moved(F.col("v"), 3, dx, dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]).first()
    assert list(got) == [[0, 0, 1, 0, 3, 4, 0, 6, 7], [1, 2, 0, 4, 5, 0, 7, 8, 0], [0, 0, 0, 0, 1, 2, 3, 4, 5], [3, 4, 5, 6, 7, 8, 0, 0, 0]]


def test_parts_are_numbered_in_reading_order_and_clipped_ones_marked(spark):
    picture = ["#.....", "......", "..##..", ".#..#.", "......"]
    raster = spark.createDataFrame([("p", x, y, 0 if c == "#" else 250) for y, line in enumerate(picture) for x, c in enumerate(line)], "page string, x int, y int, level int")
    got = {r["label"]: r for r in spatial.blobs(raster, "page", 100, 200).collect()}
    assert [(got[k]["n"], got[k]["clipped"]) for k in (1, 2)] == [(1, True), (4, False)]
    assert (got[1]["cx"], got[1]["cy"], got[2]["cx"], got[2]["cy"]) == (0.5, 0.5, 3.0, 3.0)
    assert spatial.blobs(raster.filter("level > 0"), "page", 100, 200).count() == 0


def test_a_correction_needs_one_place(spark):
    said = [(1, "Total 120.00\nPaid"), (2, "Total\nTotal"), (3, "Nothing"), (4, "Invoice numbar 7"), (5, "Invoice numbar\nInvoice number"), (6, "")]
    words = extract.placed_words(spark.createDataFrame(said, "id int, t string"), "id", "t")
    got = {r["sheet"]: r for r in extract.corrections(words, "Total", "Sum").collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "Planned", 2: "FoundTwice", 3: "NotFound", 4: "NotFound", 5: "NotFound"}
    assert got[1]["over"] is None and abs(got[1]["cover_w"] - 11.2) < 1e-9 and got[2]["x"] is None
    near = {r["sheet"]: (r["status"], r["n"]) for r in extract.corrections(words, "Invoice number", "Bill no. that is much longer").collect()}
    assert near[4] == ("Planned", 1) and near[5] == ("Planned", 1)  # an exact reading goes before a near one


def test_width_looks_at_a_text_once_for_all_characters(spark):
    texts = ["Wimbly Ünï €„“ [x]^-\\ ", "a\tb\r\n→λ", "\U0001f600i", "", None]
    for table in FACES.values():
        width = faces.width_mm(F.col("t"), table, 1.0)
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(width).collect()]
        assert got[-1] is None and all(abs(w - sum(table.get(c, 0) for c in t.replace("\t", " ")) / 1000 * 25.4 / 72) < 1e-12 for t, w in zip(texts[:-1], got[:-1], strict=True))
        assert "regexp_count" not in str(width).lower()
