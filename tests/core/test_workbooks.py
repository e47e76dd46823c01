"""Spreadsheets and documents made in the tests, read back."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import history, workbooks
from tallyframe.sources.lists import ListError


def packed(path, parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    path.write_bytes(data.getvalue())
    return str(path)


def xlsx(path, rows, *, strings=(), styles="", since_1904=False, tabs=("One",)):
    sheets = "".join(f'<sheet name="{t}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(tabs, 1))
    rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tabs) + 1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns:r="r"><workbookPr date1904="{int(since_1904)}"/><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>",
        "xl/sharedStrings.xml": "<sst>" + "".join(strings) + "</sst>",
        "xl/styles.xml": f"<styleSheet>{styles}</styleSheet>",
    }
    for i, body in enumerate(rows, 1):
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet><sheetData>{body}</sheetData></worksheet>"
    return packed(path, parts)


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="9"/><xf numFmtId="170"/></cellXfs>'


def test_cells_as_they_are_shown(spark, tmp_path):
    body = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>when</t></is></c><c r="D2" t="str"><v>share</v></c></row>'
        '<row r="5"><c r="A5" t="s"><v>1</v></c><c r="B5" s="1"><v>45487</v></c><c r="D5" s="2"><v>0.25</v></c><c r="F5"><v>9</v></c></row><row/>'
        '<row><c t="b"><v>1</v></c><c s="3"><v>1.5</v></c></row>'
    )
    path = xlsx(tmp_path / "a.xlsx", [body], strings=("<si><t> name </t></si>", "<si><r><t>An</t></r><r><t>na</t></r><rPh><t>x</t></rPh></si>"), styles=STYLES)
    got = workbooks.workbook_list(spark, path)
    assert got.columns == ["number", "name", "when", "share"]
    assert [tuple(r) for r in got.orderBy("number").collect()] == [(1, "Anna", "2024-07-14", "25%"), (2, "TRUE", "1900-01-01 12:00:00", "")]
    assert workbooks.workbook_cells(workbooks.contents(spark, xlsx(tmp_path / "b.xlsx", ['<row><c s="1"><v>1</v></c></row>'], styles=STYLES, since_1904=True))).first()["value"] == "1904-01-02"


def test_tabs(spark, tmp_path):
    path = xlsx(tmp_path / "a.xlsx", ["", '<row><c t="str"><v>a</v></c></row><row><c><v>1</v></c></row>', '<row><c t="str"><v>b</v></c></row><row><c><v>2</v></c></row>'], tabs=("Empty", "First", "Other"))
    assert workbooks.workbook_list(spark, path).columns == ["number", "a"]
    assert workbooks.workbook_list(spark, path, " oTHER ").columns == ["number", "b"]
    with pytest.raises(ListError):
        workbooks.workbook_list(spark, path, "none")


def test_ods_repeats(spark, tmp_path):
    content = (
        '<d xmlns:t="t" xmlns:x="x"><t:table t:name="S"><t:table-row><t:table-cell><x:p>h</x:p></t:table-cell><t:table-cell><x:p>k</x:p></t:table-cell></t:table-row>'
        '<t:table-row t:number-rows-repeated="2"><t:table-cell t:number-columns-repeated="2"><x:p>v</x:p><x:p>w</x:p></t:table-cell></t:table-row>'
        '<t:table-row t:number-rows-repeated="1048000"><t:table-cell t:number-columns-repeated="16000"/></t:table-row></t:table></d>'
    )
    got = workbooks.workbook_list(spark, packed(tmp_path / "a.ods", {"content.xml": content}))
    assert [tuple(r) for r in got.orderBy("number").collect()] == [(1, "v\nw", "v\nw"), (2, "v\nw", "v\nw")]


@pytest.mark.parametrize("data", [b"", b"PK\x03\x04", b"no zip"])
def test_what_is_no_workbook_is_told(spark, tmp_path, data):
    (tmp_path / "x.xlsx").write_bytes(data or b"\0")
    with pytest.raises(ListError):
        workbooks.workbook_list(spark, str(tmp_path / "x.xlsx"))


def test_bombs_are_refused(spark, tmp_path):
    doctype = packed(tmp_path / "d.ods", {"content.xml": '<!DOCTYPE d [<!ENTITY a "b">]><d/>'})
    wide = packed(tmp_path / "w.ods", {"content.xml": '<d xmlns:t="t" xmlns:x="x"><t:table><t:table-row><t:table-cell t:number-columns-repeated="99999999"><x:p>v</x:p></t:table-cell></t:table-row></t:table></d>'})
    for path in (doctype, wide):
        with pytest.raises(ListError):
            workbooks.workbook_list(spark, path)


def test_documents_as_blocks(spark, tmp_path):
    w = "xmlns:w='w'"
    docx = packed(tmp_path / "a.docx", {"word/document.xml": f"<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val='Heading 2'/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:delText>x</w:delText></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    got = [(r["block"], r["level"], r["kind"], r["text"]) for r in workbooks.document_blocks(workbooks.contents(spark, docx)).orderBy("block").collect()]
    assert got == [(1, 2, "paragraph", "Top"), (2, 0, "paragraph", "a\tb"), (3, 0, "cell", "c")]
    odt = packed(tmp_path / "a.odt", {"content.xml": "<d xmlns:x='x'><x:h x:outline-level='1'>H</x:h><x:p>one <x:span>two</x:span></x:p></d>"})
    assert [(r["level"], r["text"]) for r in workbooks.document_blocks(workbooks.contents(spark, odt)).orderBy("block").collect()] == [(1, "H"), (0, "one two")]
    (tmp_path / "a.md").write_text("# Top\r\n\r\ntext\n### Low\n#none")
    got = [(r["level"], r["text"]) for r in workbooks.plain_blocks(workbooks.whole_texts(spark, str(tmp_path / "a.md"))).orderBy("block").collect()]
    assert got == [(1, "Top"), (0, "text"), (3, "Low"), (0, "#none")]


def test_stanzas(spark, tmp_path):
    (tmp_path / "control").write_text("Package: a\nDescription: one\n two\n .\n\n\nPackage: b\nno field\nURL: http://x:1\n")
    got = {(r["stanza"], r["name"]): r["value"] for r in workbooks.stanzas(workbooks.whole_texts(spark, str(tmp_path / "control"))).collect()}
    assert got == {(1, "package"): "a", (1, "description"): "one\n two\n .", (2, "package"): "b\nno field".split("\n")[0], (2, "url"): "http://x:1"}


def test_history_keeps_the_newest(spark, tmp_path):
    entries = spark.range(30).select(F.col("id").alias("at"), F.lit("s").alias("source"), F.lit("d").alias("delta"), F.lit(1).alias("pages"), F.lit(0).alias("additions"), (F.col("id") % 7).cast("string").alias("fingerprint"))
    path = f"{tmp_path}/log"
    history.append(entries.filter("at < 20"), path)
    history.append(entries.filter("at >= 20"), path)
    (tmp_path / "log" / "bad.json").write_text('{"at": 5}\nnonsense\n\n')
    assert history.read(spark, path).count() == 30
    assert sorted(r["at"] for r in history.compact(spark, path, f"{tmp_path}/new", 5).collect()) == [25, 26, 27, 28, 29]
    files = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None)], "path string, fingerprint string")
    assert {r["path"]: (r["status"], r["at"]) for r in history.printed_before(files, spark, path).collect()} == {"a": ("printed", 29), "b": ("new", None), "c": ("unreadable", None)}
