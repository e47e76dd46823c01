"""Options, attempts, saved documents, leaning pages."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.options import Options, attempted, saved_document
from tallyframe.operators.fits import leaning


def test_options_have_bounds():
    assert Options().over(dpi=300.0, pad=None) == Options(dpi=300.0)
    for wrong in ({"dpi": 1.0}, {"threshold": 0}, {"what": 1}):
        with pytest.raises(ValueError):
            Options().over(**wrong)


def test_what_fails_stays_as_a_row(spark):
    df = spark.createDataFrame([("1 2",), ("x",), (None,)], "t string")
    got = df.select("t", attempted(F.col("t"), lambda t: [float(x) for x in t.split()]).alias("r")).collect()
    assert [(r["t"], r["r"]["value"], r["r"]["error"] is None) for r in got] == [("1 2", [1.0, 2.0], True), ("x", None, False), (None, None, False)]


def test_saved_documents_are_told_apart(spark):
    files = [(b"", "empty"), (b"%PDF-1.4", "a PDF"), (b"PK\x03\x04", "a zip file"), (b"\xff\xfe{", "no text"), (b"{", "damaged"), (b"[1]", "damaged"), (b'{"a": 1, "b": 2}', None)]
    doc, fault = saved_document(F.col("c"), "a int, d string")
    got = spark.createDataFrame([(bytearray(c),) for c, _ in files], "c binary").select(doc.alias("d"), fault.alias("f")).collect()
    assert [r["f"] for r in got] == [f for _, f in files] and got[-1]["d"]["a"] == 1 and got[0]["d"] is None


def test_a_lean_is_found(spark):
    rows = [(1, float(x), float(line * 10 + 3.2 + x * 0.0262)) for line in range(20) for x in range(0, 200, 5)] + [(2, 1.0, 1.0)]
    got = {r["p"]: r["degrees"] for r in leaning(spark.createDataFrame(rows, "p int, x double, y double"), ["p"], "x", "y", 3.0).collect()}
    assert abs(got[1] - 1.5) < 0.25 and got[2] == 0.0
