"""Spreadsheets and word-processor files as tables. A file is opened by one task; its rows go on as Spark rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.measure import serial_date
from tallyframe.functions.text import trimmed
from tallyframe.operators.tables import written
from tallyframe.sources.lists import ListError

#: The most rows, columns and cells of a sheet; the most bytes that a part may come to when unpacked.
MOST_ROWS, MOST_COLUMNS, MOST_CELLS, MOST_BYTES = 1_048_576, 16_384, 5_000_000, 1 << 29

#: Numbers of built-in formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    """A part's XML; without document types, so that entities can't grow."""
    if name not in archive.namelist():
        return None
    if archive.getinfo(name).file_size > MOST_BYTES:
        raise ListError(f"{name} is too large")
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:4096]:
        raise ListError(f"{name} has a document type")
    return ElementTree.fromstring(data)


def texts(element: ElementTree.Element, skip: tuple[str, ...] = ("rPh",)) -> str:
    """The text of `t` elements, phonetic runs left out."""
    if local(element.tag) in skip:
        return ""
    own = element.text or "" if local(element.tag) == "t" else ""
    return own + "".join(texts(child, skip) for child in element)


def column_of(ref: str) -> int:
    """A1 to a column number, from 0."""
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_cells(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str, str]]:
    """(tab, row, column, kind, value) of cells; kind is text, bool, number, date, date1904 or percent."""
    book, rels = part(archive, "xl/workbook.xml"), part(archive, "xl/_rels/workbook.xml.rels")
    shared_part, styles = part(archive, "xl/sharedStrings.xml"), part(archive, "xl/styles.xml")
    shared = [texts(si) for si in shared_part] if shared_part is not None else []
    targets = {r.get("Id"): r.get("Target") for r in rels} if rels is not None else {}
    since_1904 = any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
    custom, formats = {}, []
    for e in styles.iter() if styles is not None else ():
        if local(e.tag) == "numFmt":
            custom[int(e.get("numFmtId"))] = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", e.get("formatCode", ""))
        elif local(e.tag) == "cellXfs":
            formats = [int(x.get("numFmtId", 0)) for x in e]

    def shows(style: str | None) -> str:
        number = formats[int(style)] if style and int(style) < len(formats) else 0
        code = custom.get(number, "")
        if number in DATE_FORMATS or re.search("[ymdhs]", code, re.I) and not re.search("general", code, re.I):
            return "date1904" if since_1904 else "date"
        return "percent" if number in (9, 10) or "%" in code else "number"

    for n, sheet in enumerate((e for e in book.iter() if local(e.tag) == "sheet"), 1):
        rid = next((v for k, v in sheet.attrib.items() if local(k) == "id"), None)
        target = targets.get(rid, f"worksheets/sheet{n}.xml")
        page = part(archive, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        row_no = cells = 0
        for row in page.iter() if page is not None else ():
            if local(row.tag) != "row":
                continue
            row_no = int(row.get("r", row_no + 1))
            at = -1
            for c in row:
                at = column_of(c.get("r", "")) if c.get("r") else at + 1
                cells += 1
                if row_no > MOST_ROWS or at >= MOST_COLUMNS or cells > MOST_CELLS:
                    raise ListError("the sheet is too large")
                kind, value = c.get("t", "n"), next((v.text or "" for v in c if local(v.tag) == "v"), "")
                if kind == "s":
                    yield sheet.get("name"), row_no, at, "text", shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    yield sheet.get("name"), row_no, at, "text", texts(c)
                elif kind == "b":
                    yield sheet.get("name"), row_no, at, "text", "TRUE" if value == "1" else "FALSE"
                elif kind in ("str", "e"):
                    yield sheet.get("name"), row_no, at, "text", value
                else:
                    yield sheet.get("name"), row_no, at, shows(c.get("s")) if value else "text", value


def ods_cells(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str, str]]:
    """The same of an ODS file; repeated cells and rows are given as often, blank ones not at all."""
    content = part(archive, "content.xml")
    for sheet in content.iter():
        if local(sheet.tag) != "table":
            continue
        name = next((v for k, v in sheet.attrib.items() if local(k) == "name"), "")
        row_no = cells = 0
        for row in (r for r in sheet.iter() if local(r.tag) == "table-row"):
            again = {local(k): v for k, v in row.attrib.items()}
            times, at, held = int(again.get("number-rows-repeated", 1)), 0, []
            for c in row:
                if local(c.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                repeat = int({local(k): v for k, v in c.attrib.items()}.get("number-columns-repeated", 1))
                said = "\n".join("".join(p.itertext()) for p in c if local(p.tag) == "p")
                if said:
                    if at + repeat > MOST_COLUMNS:
                        raise ListError("the sheet is too large")
                    held += [(at + i, said) for i in range(repeat)]
                at += repeat
            cells += len(held) * times
            if held and (cells > MOST_CELLS or row_no + times > MOST_ROWS):
                raise ListError("the sheet is too large")
            for i in range(times if held else 0):
                for column, said in held:
                    yield name, row_no + 1 + i, column, "text", said
            row_no += times


def paragraphs(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str, str]]:
    """(style, block, level, kind, text) of paragraphs of a DOCX or ODT file, in order; deleted text, fields' codes and
    fallbacks are left out; cells of tables are told by kind."""
    docx = part(archive, "word/document.xml")
    root = docx if docx is not None else part(archive, "content.xml")
    block = 0

    def inside(e: ElementTree.Element, cell: bool) -> Iterator[tuple[str, int, int, str, str]]:
        nonlocal block
        tag = local(e.tag)
        if tag in ("delText", "instrText", "Fallback", "tracked-changes"):
            return
        if tag in ("p", "h"):
            if docx is not None:
                style = next((s.get(k, "") for s in e.iter() if local(s.tag) == "pStyle" for k in s.attrib), "")
                said = "".join((x.text or "") if local(x.tag) == "t" else "\t" if local(x.tag) == "tab" else "" for x in e.iter())
            else:
                style = next((v for k, v in e.attrib.items() if local(k) == "style-name"), "")
                said = "".join(e.itertext())
            level = re.search(r"(?i)heading\s*(\d)", style)
            outline = next((v for k, v in e.attrib.items() if local(k) == "outline-level"), None)
            block += 1
            yield style, block, int(outline or (level[1] if level else 0)), "cell" if cell else "paragraph", said
            return
        for child in e:
            yield from inside(child, cell or tag in ("tc", "table-cell"))

    yield from inside(root, False)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def opened(found: DataFrame, wanted: str) -> DataFrame:
    """(path, content) -> (path, tab, row, column, kind, value, error); what can't be read is a row with an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "tab_no", "tab", "row", "column", "kind", "value", "error"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        parts = set(archive.namelist())
                        if wanted == "text":
                            cells = paragraphs(archive)
                        elif "xl/workbook.xml" in parts:
                            cells = xlsx_cells(archive)
                        elif "content.xml" in parts:
                            cells = ods_cells(archive)
                        else:
                            raise ListError("a zip file, but no spreadsheet")
                        tab_no, tab = 0, None
                        for cell in cells:
                            tab_no, tab = (tab_no, tab) if cell[0] == tab else (tab_no + 1, cell[0])
                            rows.append((file, tab_no, *cell, None))
                            if len(rows) == 50_000:
                                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                                rows = []
                except (zipfile.BadZipFile, ElementTree.ParseError, ListError, AttributeError, TypeError, KeyError, NotImplementedError) as e:
                    rows.append((file, *[None] * 6, str(e) or type(e).__name__))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return found.select("path", "content").mapInArrow(read, "path string, tab_no long, tab string, row long, column long, kind string, value string, error string")


def workbook_cells(files: DataFrame) -> DataFrame:
    """(path, content) of spreadsheets -> (path, tab_no, tab, row, column, value, error), each cell as it is shown; tabs are
    numbered in their order."""
    cells = opened(files, "cells")
    number = F.col("value").try_cast("double")
    percent = F.concat(F.regexp_replace(F.round(number * 100, 10).cast("string"), r"[.]0$", ""), F.lit("%"))
    shown = F.when(F.col("kind") == "date", F.coalesce(serial_date(number), "value")).when(F.col("kind") == "date1904", F.coalesce(serial_date(number, since_1904=True), "value")).when((F.col("kind") == "percent") & number.isNotNull(), percent).otherwise(F.col("value"))
    return cells.select("path", "tab_no", "tab", "row", "column", shown.alias("value"), "error")


def workbook_rows(cells: DataFrame, tab: str | None = None) -> DataFrame:
    """`workbook_cells` -> (path, number, column, name, value) of each file's list, in long form.

    A file's list is in the tab that is called so (case and outer spaces aside), or in the first with a value. The
    first row with a value is the header, its names trimmed. Rows without values are left out, and cells beyond the
    header; an empty cell has no row here. Numbers go by place.
    """
    full = cells.filter("error IS NULL").withColumn("value", trimmed(F.col("value"))).filter("value <> ''")
    if tab is not None:
        full = full.filter(F.lower(trimmed(F.col("tab"))) == tab.strip().lower())
    first = full.groupBy("path").agg(F.min(F.struct("tab_no", "row")).alias("f")).select("path", F.col("f.tab_no").alias("tab_no"), F.col("f.row").alias("head"))
    own = full.join(first, ["path", "tab_no"])
    names = own.filter("row = head").select("path", "column", F.col("value").alias("name"))
    # A sheet has a bounded number of rows.
    order = own.filter("row > head").select("path", "row").distinct().withColumn("number", F.row_number().over(Window.partitionBy("path").orderBy("row")).cast("long"))
    return own.filter("row > head").join(names, ["path", "column"]).join(order, ["path", "row"]).select("path", "number", "column", "name", "value")


def workbook_list(spark: SparkSession, path: str, tab: str | None = None) -> DataFrame:
    """One workbook's list with a column for each name, short rows filled up with empty texts."""
    cells = written(workbook_cells(contents(spark, path)), "cells")
    bad = cells.filter("error IS NOT NULL").select("error").first()
    if bad:
        raise ListError(bad[0])
    rows = workbook_rows(cells, tab)
    names = rows.groupBy("column").agg(F.first("name").alias("name")).orderBy("column").collect()
    full = cells.filter(trimmed(F.col("value")) != "")
    if tab is not None:
        full = full.filter(F.lower(trimmed(F.col("tab"))) == tab.strip().lower())
    if full.isEmpty():
        raise ListError("there is no such tab with rows in it")
    if not names:
        raise ListError("the list has no rows")
    head = full.groupBy("tab_no").agg(F.min("row").alias("row")).orderBy("tab_no").first()
    named = {r["column"]: r["value"].strip() for r in full.filter((F.col("tab_no") == head["tab_no"]) & (F.col("row") == head["row"])).collect()}
    return rows.groupBy("number").agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("value"))), F.lit("")).alias(n) for c, n in sorted(named.items())])


def document_blocks(files: DataFrame) -> DataFrame:
    """(path, content) of word-processor files -> (path, block, level, kind, style, text, error): level is that of a
    heading, 0 else."""
    return opened(files, "text").select("path", F.col("row").alias("block"), F.col("column").alias("level"), "kind", F.col("tab").alias("style"), F.col("value").alias("text"), "error")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def plain_blocks(files: DataFrame) -> DataFrame:
    """(path, value) of plain text and Markdown files -> (path, block, level, text), line by line; a heading's level is its
    number signs."""
    lines = files.select("path", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("block", "said")).filter(F.trim("said") != "")
    marks = F.regexp_extract("said", r"^(#{1,6})\s", 1)
    return lines.select("path", (F.col("block") + 1).alias("block"), F.length(marks).alias("level"), F.regexp_replace("said", r"^#{1,6}\s+", "").alias("text"))


def stanzas(files: DataFrame) -> DataFrame:
    """(path, value) of control files -> (path, stanza, name, value): `Name: value`, lines that begin with white space carry on, blank lines
    end a stanza; names are lower-cased."""
    whole = files.select("path", F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    parts = whole.select("path", F.posexplode(F.filter(F.split("value", r"\n[ \t]*\n+"), lambda s: F.trim(s) != "")).alias("stanza", "said"))
    fields = parts.select("path", (F.col("stanza") + 1).alias("stanza"), F.explode(F.split("said", r"\n(?=[^ \t\n])")).alias("field")).filter(F.contains("field", F.lit(":")))
    name = F.lower(F.trim(F.substring_index("field", ":", 1)))
    return fields.select("path", "stanza", name.alias("name"), F.regexp_replace(F.substr("field", F.locate(":", F.col("field")) + 1), r"^\s+|\s+$", "").alias("value"))
