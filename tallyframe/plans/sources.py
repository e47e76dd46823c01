"""Files of the kinds that the library reads and writes, made of the standard tables and read back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import options
from tallyframe.functions.options import attempted, saved_document
from tallyframe.functions.text import escape_html
from tallyframe.operators.sequence import SeriesCounters
from tallyframe.operators.tables import shared_folder, written
from tallyframe.plans.registry import query, table
from tallyframe.sources import files, history, lists, workbooks
from tallyframe.streaming import arrivals


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def zipped(parts: DataFrame) -> DataFrame:
    """(path, parts: name -> text) -> (path, content)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts_ in batch.column(1).to_pylist():
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
                    for name, text in parts_:
                        archive.writestr(name, text)
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return parts.select("path", "parts").mapInArrow(pack, "path string, content binary")


def in_order(of: Column, order: str) -> Column:
    """Texts of a group, put together by an order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), of.alias("t")))), lambda s: s["t"]), "")


STYLES = '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="9"/><xf numFmtId="170"/></cellXfs></styleSheet>'


def workbooks_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """A workbook for each nation and each hundred thousand suppliers: an empty tab, and one with rows of text, dates, shares and truths, with gaps."""
    k = F.col("s_suppkey")
    cell = lambda col, kind, body: F.concat(F.lit(f'<c r="{col}'), F.col("r").cast("string"), F.lit(f'"{kind}>'), body, F.lit("</c>"))
    number = lambda v: F.concat(F.lit("<v>"), v.cast("string"), F.lit("</v>"))
    rows = table(spark, d, "supplier").withColumn("r", 4 + 2 * (k % 100_000))
    inline = F.concat(F.lit("<is><t> "), escape_html(F.concat("s_name", F.lit(" & <co>"))), F.lit("</t></is>"))
    body = F.concat(F.lit('<row r="'), F.col("r").cast("string"), F.lit('">'), cell("A", ' t="inlineStr"', inline), cell("B", ' s="1"', number(40_000 + k % 9_000)), cell("D", ' s="2"', number(k % 400 / 1000.0)), F.when(k % 2 == 0, cell("E", ' t="b"', number(F.floor(k % 4 / 2)))).otherwise(""), cell("G", ' t="str"', F.lit("<v>beyond</v>")), F.lit("</row>"))
    head = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>share </t></is></c><c r="E2" t="str"><v>true</v></c></row>'
    sheets = rows.groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("-"), F.floor(k / 100_000).cast("string")).alias("path")).agg(in_order(body, "s_suppkey").alias("rows"))
    fixed = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Empty" sheetId="1" r:id="rId1"/><sheet name=" Stock " sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t> name </t></si><si><r><t>wh</t></r><r><t>en</t></r><rPh><t>x</t></rPh></si></sst>",
        "xl/styles.xml": STYLES,
        "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row/></sheetData></worksheet>",
    }
    whole = F.concat(F.lit(f"<worksheet><sheetData>{head}"), F.col("rows"), F.lit("</sheetData></worksheet>"))
    parts = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv], F.lit("xl/worksheets/sheet2.xml"), whole)
    return zipped(sheets.select("path", parts.alias("parts")))


@query(
    "workbook_rows",
    """WITH s AS (SELECT *, 'n' || s_nationkey || '-' || s_suppkey // 100000 AS path, row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 100000 ORDER BY s_suppkey) AS number FROM supplier)
       SELECT path, number, 0 AS "column", 'name' AS name, s_name || ' & <co>' AS value FROM s
       UNION ALL SELECT path, number, 1, 'when', strftime(DATE '1899-12-30' + (40000 + s_suppkey % 9000)::INT, '%Y-%m-%d') FROM s
       UNION ALL SELECT path, number, 3, 'share', CASE WHEN s_suppkey % 10 = 0 THEN (s_suppkey % 400 // 10)::VARCHAR ELSE (s_suppkey % 400 / 10.0::DOUBLE)::VARCHAR END || '%' FROM s
       UNION ALL SELECT path, number, 4, 'true', CASE WHEN s_suppkey % 4 = 2 THEN 'TRUE' ELSE 'FALSE' END FROM s WHERE s_suppkey % 2 = 0""",
)
def workbook_rows(spark, d):
    return workbooks.workbook_rows(workbooks.workbook_cells(workbooks_of_suppliers(spark, d)), tab="stock")


@query(
    "ods_rows",
    """WITH n AS (SELECT *, 'r' || n_regionkey AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
            t AS (SELECT n.*, unnest(range(0, 1 + n_nationkey % 3)) AS again FROM n),
            o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n_nationkey, again) AS number FROM t)
       SELECT path, number, c AS "column", CASE c WHEN 0 THEN 'h' ELSE 'k' END AS name, CASE c WHEN 0 THEN n_name ELSE n_name || chr(10) || n_nationkey END AS value FROM o, range(0, 2) x(c)""",
)
def ods_rows(spark, d):
    """Rows that are repeated, blank rows by the thousand, and cells of two paragraphs."""
    row = F.concat(F.lit('<t:table-row t:number-rows-repeated="'), (1 + F.col("n_nationkey") % 3).cast("string"), F.lit('"><t:table-cell><x:p>'), F.col("n_name"), F.lit("</x:p></t:table-cell><t:table-cell><x:p>"), F.col("n_name"), F.lit("</x:p><x:p>"), F.col("n_nationkey").cast("string"), F.lit('</x:p></t:table-cell></t:table-row><t:table-row t:number-rows-repeated="1000"><t:table-cell t:number-columns-repeated="16000"/></t:table-row>'))
    head = '<d xmlns:t="t" xmlns:x="x"><t:table t:name="S"><t:table-row><t:table-cell><x:p>h</x:p></t:table-cell><t:table-cell><x:p>k</x:p></t:table-cell></t:table-row>'
    sheets = table(spark, d, "nation").groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path")).agg(in_order(row, "n_nationkey").alias("rows"))
    content = F.concat(F.lit(head), F.col("rows"), F.lit("</t:table></d>"))
    made = zipped(sheets.select("path", F.create_map(F.lit("content.xml"), content).alias("parts")))
    return workbooks.workbook_rows(workbooks.workbook_cells(made))


@query(
    "word_blocks",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
       SELECT 'c' || conv_id AS path, 2 * i - 1 AS block, CASE WHEN role = 'user' THEN 2 ELSE 0 END AS level, 'paragraph' AS kind, sha256(role) AS said FROM t
       UNION ALL SELECT 'c' || conv_id, 2 * i, 0, CASE WHEN turn % 2 = 1 THEN 'cell' ELSE 'paragraph' END, sha256('[' || chr(9) || text || ']') FROM t""",
)
def word_blocks(spark, d):
    """A document for each conversation: headings, tabs, deleted words, tables."""
    heading = F.when(F.col("role") == "user", '<w:pPr><w:pStyle w:val="Heading 2"/></w:pPr>').otherwise("")
    p = lambda *inner: F.concat(F.lit("<w:p>"), *inner, F.lit("</w:p>"))
    said = p(F.lit("<w:r><w:t>[</w:t><w:tab/><w:t>"), escape_html(F.col("text")), F.lit("</w:t><w:delText>gone</w:delText><w:t>]</w:t></w:r>"))
    said = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("<w:tbl><w:tr><w:tc>"), said, F.lit("</w:tc></w:tr></w:tbl>"))).otherwise(said)
    body = F.concat(p(heading, F.lit("<w:r><w:t>"), F.col("role"), F.lit("</w:t></w:r>")), said)
    whole = table(spark, d, "conversations").groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path")).agg(in_order(body, "turn").alias("body"))
    content = F.concat(F.lit('<w:document xmlns:w="w"><w:body>'), F.col("body"), F.lit("</w:body></w:document>"))
    got = workbooks.document_blocks(zipped(whole.select("path", F.create_map(F.lit("word/document.xml"), content).alias("parts"))))
    return got.select("path", "block", F.col("level").cast("int").alias("level"), "kind", F.sha2("text", 256).alias("said"))


@query(
    "odt_blocks",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
       SELECT 'c' || conv_id AS path, 2 * i - 1 AS block, 3 AS level, sha256(role) AS said FROM t UNION ALL SELECT 'c' || conv_id, 2 * i, 0, sha256(text || '!') FROM t""",
)
def odt_blocks(spark, d):
    body = F.concat(F.lit('<x:tracked-changes><x:p>old</x:p></x:tracked-changes><x:h x:outline-level="3">'), F.col("role"), F.lit("</x:h><x:p>"), escape_html(F.col("text")), F.lit("<x:span>!</x:span></x:p>"))
    whole = table(spark, d, "conversations").groupBy(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path")).agg(in_order(body, "turn").alias("body"))
    got = workbooks.document_blocks(zipped(whole.select("path", F.create_map(F.lit("content.xml"), F.concat(F.lit('<d xmlns:x="x">'), F.col("body"), F.lit("</d>"))).alias("parts"))))
    return got.select("path", "block", F.col("level").cast("int").alias("level"), F.sha2("text", 256).alias("said"))


@query(
    "text_blocks",
    """WITH l AS (SELECT doc_id, unnest(s) AS said, generate_subscripts(s, 1) AS block FROM (SELECT doc_id, string_split_regex(CASE doc_id % 3 WHEN 0 THEN '## ' WHEN 1 THEN '#no ' ELSE '' END || text, '\\r\\n|\\n|\\r') AS s FROM documents))
       SELECT doc_id::VARCHAR AS path, block::INT AS block, CASE WHEN block = 1 AND doc_id % 3 = 0 THEN 2 WHEN block > 1 OR doc_id % 3 <> 0 THEN length(regexp_extract(said, '^(#{1,6})\\s', 1)) END::INT AS level,
              sha256(regexp_replace(said, '^#{1,6}\\s+', '')) AS said FROM l WHERE trim(said, ' ') <> ''""",
)
def text_blocks(spark, d):
    mark = F.when(F.col("doc_id") % 3 == 0, "## ").when(F.col("doc_id") % 3 == 1, "#no ").otherwise("")
    got = workbooks.plain_blocks(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(mark, "text").alias("value")))
    return got.select("path", "block", "level", F.sha2("text", 256).alias("said"))


@query(
    "control_stanzas",
    """WITH s AS (SELECT *, 'b' || p_brand || '/' || p_partkey // 2500 AS path, row_number() OVER (PARTITION BY p_brand, p_partkey // 2500 ORDER BY p_partkey) AS stanza FROM part)
       SELECT path, stanza::INT AS stanza, 'package' AS name, p_name AS value FROM s UNION ALL SELECT path, stanza, 'description', p_type || ': more' || chr(10) || ' of it' || chr(10) || ' .' FROM s UNION ALL SELECT path, stanza, 'size', p_size::VARCHAR FROM s WHERE p_size % 2 = 0""",
)
def control_stanzas(spark, d):
    own = F.concat(F.lit("Package:  "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "\r\n").otherwise("\n"), F.lit("Description: "), F.col("p_type"), F.lit(": more\n of it\n .\n"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("SIZE:"), F.col("p_size").cast("string"), F.lit("\n"))).otherwise("no field at all\n"), F.lit("\n \n"))
    # A brand's parts among 2,500 keys, some hundred, to a file.
    whole = table(spark, d, "part").groupBy(F.concat(F.lit("b"), "p_brand", F.lit("/"), F.floor(F.col("p_partkey") / 2500)).alias("path")).agg(in_order(own, "p_partkey").alias("value"))
    return workbooks.stanzas(whole)


@query(
    "file_kinds",
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'zip' WHEN 1 THEN 'pdf' WHEN 2 THEN 'picture' WHEN 3 THEN 'picture' WHEN 4 THEN 'text' WHEN 5 THEN 'unknown' ELSE 'text' END AS kind FROM part""",
)
def file_kinds(spark, d):
    """By first bytes, whatever a file is called."""
    starts = ("504B0304", "255044462D312E37", "89504E470D0A1A0A00", "FFD8FFE0", "C3A9", "C328", "")
    content = F.concat(F.unhex(F.element_at(F.array(*[F.lit(s) for s in starts]), (F.col("p_partkey") % 7 + 1).cast("int"))), F.col("p_name").cast("binary"))
    return table(spark, d, "part").select("p_partkey", files.kind_by_content(content).alias("kind"))


AWKWARD = """CASE c_custkey % 5 WHEN 0 THEN c_name || ', "the ' || c_mktsegment || '"' WHEN 1 THEN c_name || chr(10) || 'second line' WHEN 2 THEN '' WHEN 3 THEN '"' ELSE c_mktsegment END"""


def awkward() -> Column:
    k = F.col("c_custkey") % 5
    return F.when(k == 0, F.concat("c_name", F.lit(', "the '), "c_mktsegment", F.lit('"'))).when(k == 1, F.concat("c_name", F.lit("\nsecond line"))).when(k == 2, "").when(k == 3, '"').otherwise(F.col("c_mktsegment"))


@query(
    "list_records",
    f"""WITH c AS (SELECT *, {AWKWARD} AS note, c_custkey // 500 AS f, row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) AS i FROM customer)
        SELECT 'f' || f AS path, i::INT AS "at", [c_custkey::VARCHAR, note, 'a"b'] AS cells FROM c UNION ALL SELECT DISTINCT 'f' || f, 0, ['key', ' note', 'last '] FROM c""",
)
def list_records(spark, d):
    """Quotes that stand inside a field, line ends of three kinds, a byte order mark, one quote that is never closed."""
    k = F.col("c_custkey")
    quoted = F.concat(F.lit('"'), F.replace(awkward(), F.lit('"'), F.lit('""')), F.lit('"'))
    end = F.when(k % 3 == 0, "\r\n").when(k % 3 == 1, "\r").otherwise("\n")
    last = F.when(k % 2 == 0, 'a"""b"').otherwise('"a""b"')
    rows = table(spark, d, "customer").select(k, F.floor(k / 500).alias("f"), F.concat(k.cast("string"), F.lit(","), F.when(awkward() == F.col("c_mktsegment"), awkward()).otherwise(quoted), F.lit(","), last, end).alias("line"))
    whole = rows.groupBy(F.concat(F.lit("f"), F.col("f").cast("string")).alias("path")).agg(in_order(F.col("line"), "c_custkey").alias("rows"))
    # The last line end is taken off: with or without it, a file has the same records but for an empty one.
    content = F.concat(F.lit('﻿key, note,"last "\n'), F.regexp_replace("rows", r"[\r\n]+$", ""))
    return lists.records(whole.select("path", content.alias("content"))).select("path", "at", "cells")


@query("list_read_back", f"""SELECT c_custkey::VARCHAR AS key, {AWKWARD} AS note FROM customer""")
def list_read_back(spark, d):
    """A report is written as CSV into the shared folder and read as a list."""
    path = folder(spark, "report")
    lists.write_report(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), awkward().alias("note")), path)
    return lists.read_list(spark, f"{path}/*.csv").select("key", "note")


@query("log_entries", """SELECT event_id AS at, event_type AS source FROM events WHERE event_id % 5 IN (0, 1)""")
def log_entries(spark, d):
    """Lines that are blank or damaged, and entries without a required field, are left out."""
    k = F.col("event_id")
    good = F.to_json(F.struct(k.alias("at"), F.col("event_type").alias("source")))
    line = F.when(k % 5 == 2, "").when(k % 5 == 3, F.concat(F.lit("{"), good)).when(k % 5 == 4, F.to_json(F.struct(k.alias("at")))).otherwise(good)
    path = folder(spark, "log")
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return lists.read_log(spark, path, "at long, source string", ["at", "source"])


@query("report_json", """SELECT p_partkey, '{"name":"' || p_name || '","at":{"x":' || (p_size / 4.0)::DOUBLE || ',"marks":[' || p_size || ',2]}}' AS json FROM part""")
def report_json(spark, d):
    inner = F.struct((F.col("p_size") / 4).alias("x"), F.array("p_size", F.lit(2).cast("long")).alias("marks"))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), inner.alias("at"))
    return parts.select("p_partkey", F.to_json(F.struct("name", "at")).alias("json"))


@query("history_kept", """SELECT event_id AS at, event_type AS source, user_id::VARCHAR AS fingerprint FROM events ORDER BY event_id DESC LIMIT 500""")
def history_kept(spark, d):
    """A log that is added to twice and cut down to its newest 500 entries."""
    e = table(spark, d, "events").select(F.col("event_id").alias("at"), F.col("event_type").alias("source"), F.lit("d").alias("delta"), F.lit(1).cast("long").alias("pages"), F.lit(0).cast("long").alias("additions"), F.col("user_id").cast("string").alias("fingerprint"))
    path = folder(spark, "history")
    history.append(e.filter("at % 3 = 0"), path)
    history.append(e.filter("at % 3 <> 0"), path)
    return history.compact(spark, path, folder(spark, "history")).select("at", "source", "fingerprint")


@query(
    "printed_before",
    """WITH l AS (SELECT user_id::VARCHAR AS fingerprint, max(event_id) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1)
       SELECT c_custkey AS path, CASE WHEN c_custkey % 10 = 9 THEN 'unreadable' WHEN l.at IS NULL THEN 'new' ELSE 'printed' END AS status, CASE WHEN c_custkey % 10 <> 9 THEN l.at END AS at FROM customer LEFT JOIN l ON l.fingerprint = c_custkey::VARCHAR""",
)
def printed_before(spark, d):
    e = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("at"), F.lit("s").alias("source"), F.lit("d").alias("delta"), F.lit(1).cast("long").alias("pages"), F.lit(0).cast("long").alias("additions"), F.col("user_id").cast("string").alias("fingerprint"))
    path = folder(spark, "history")
    history.append(e, path)
    key = F.when(F.col("c_custkey") % 10 != 9, F.col("c_custkey").cast("string"))
    return history.printed_before(table(spark, d, "customer").select(F.col("c_custkey").alias("path"), key.alias("fingerprint")), spark, path).select("path", "status", "at")


@query(
    "ledger_compacted",
    """WITH l AS (SELECT o_custkey::VARCHAR AS path, max(o_orderkey) AS "at", arg_max(o_orderstatus, o_orderkey) AS outcome FROM orders GROUP BY 1),
            h AS (SELECT *, path::BIGINT % 10 = 0 AS here FROM l), n AS (SELECT greatest(0, (400 - count(*)) // 2) AS room FROM h WHERE here)
       SELECT path, "at", outcome FROM h WHERE here UNION ALL SELECT path, "at", outcome FROM (SELECT *, row_number() OVER (ORDER BY "at" DESC, path) AS i FROM h WHERE NOT here) WHERE i <= (SELECT room FROM n)""",
)
def ledger_compacted(spark, d):
    ledger = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("outcome"))
    present = ledger.filter(F.col("path").cast("long") % 10 == 0)
    return arrivals.compacted(ledger, present, most=400)


@query(
    "saved_documents",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name END AS title, CASE p_partkey % 7 WHEN 1 THEN 'empty' WHEN 2 THEN 'a PDF' WHEN 3 THEN 'a zip file' WHEN 4 THEN 'no text' WHEN 5 THEN 'damaged' WHEN 6 THEN 'damaged' END AS fault FROM part""",
)
def saved_documents(spark, d):
    k = F.col("p_partkey") % 7
    good = F.to_json(F.struct(F.col("p_name").alias("title"))).cast("binary")
    content = F.when(k == 0, good).when(k == 1, F.unhex(F.lit(""))).when(k == 2, F.unhex(F.lit("255044462D"))).when(k == 3, F.unhex(F.lit("504B030414"))).when(k == 4, F.unhex(F.lit("7BC328"))).when(k == 5, F.lit("[1, 2]").cast("binary")).otherwise(F.lit('{"title": ').cast("binary"))
    document, fault = saved_document(content, "title string")
    return table(spark, d, "part").select("p_partkey", document["title"].alias("title"), fault.alias("fault"))


@query("signatures_or_errors", """SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN [length(p_name)::DOUBLE, p_size::DOUBLE] END AS value, CASE WHEN p_size % 4 = 0 THEN 'nothing to see on ' || p_size END AS error FROM part""")
def signatures_or_errors(spark, d):
    """A function that gives numbers for a text or fails; what fails stays as a row that says why."""

    def work(text: str) -> list[float]:
        name, size = text.rsplit("|", 1)
        if int(size) % 4 == 0:
            raise ValueError(f"nothing to see on {size}")
        return [float(len(name)), float(size)]

    got = table(spark, d, "part").withColumn("r", attempted(F.concat("p_name", F.lit("|"), F.col("p_size").cast("string")), work))
    return got.select("p_partkey", "r.value", "r.error")


@query(
    "tunables_laid_over",
    """SELECT o_orderkey, 200.0::DOUBLE AS threshold, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 WHEN c_custkey % 4 = 0 THEN c_custkey % 20 / 10 ELSE 0.12 END::DOUBLE AS tolerance, 2.0::DOUBLE AS "group", 0.05::DOUBLE AS least,
              CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 0.3 END::DOUBLE AS pad, 5.0::DOUBLE AS margin, CASE WHEN o_orderkey % 7 = 0 THEN 30 ELSE 400 END::DOUBLE AS dpi,
              CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 50 > 25 THEN 'tolerance' WHEN o_orderkey % 7 = 0 THEN 'dpi' END AS refused
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def tunables_laid_over(spark, d):
    """For each run: what it was given, else its user's own default, else the library's; and the first out of bounds."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    users = table(spark, d, "customer").select(c, F.when(c % 4 == 0, c % 20 / 10).alias("own_tolerance"), F.when(c % 5 == 0, 0.0).alias("own_pad"))
    runs = table(spark, d, "orders").select(o, "o_custkey", F.when(o % 3 == 0, o % 50).alias("given_tolerance"), F.when(o % 7 == 0, 30.0).alias("given_dpi"))
    laid = options.laid_over(runs.join(users, F.col("o_custkey") == c, "left"), ["given_", "own_"])
    return laid.select("o_orderkey", *options.BOUNDS, "refused")


@query(
    "field_specs",
    """SELECT p_partkey, p_brand AS name, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name ELSE p_name || '/' || p_type END AS label,
              CASE WHEN p_partkey % 5 IN (1, 3, 4) THEN 'below' ELSE 'after' END AS place, p_partkey % 5 IN (2, 3) AS is_number FROM part""",
)
def field_specs(spark, d):
    """Specs made of parts: a name, a label that may have a stroke in it, and suffixes in any order."""
    k = F.col("p_partkey")
    label = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(" = "), "p_name")).otherwise(F.concat(F.lit("="), "p_name", F.lit("/"), "p_type"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", "/below", " /number", "/below/number", "/below/after ")]), (k % 5 + 1).cast("int"))
    f = options.field_of(F.concat("p_brand", label, suffix))
    return table(spark, d, "part").select("p_partkey", *[f[c].alias(c) for c in ("name", "label", "place", "is_number")])


@query("series_counters", """SELECT r_name AS name, 1 + count(n_nationkey) AS next FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def series_counters(spark, d):
    """A series for each region, advanced by its nations; a run that read an old state is told so and changes nothing."""
    counters = SeriesCounters(spark, folder(spark, "series"))
    sizes = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n"))
    for r in sizes.collect():  # five regions
        start = counters.start(r["r_name"])
        counters.reached(r["r_name"], start, start + r["n"])
    return spark.createDataFrame([*counters.all().items()], "name string, next long")


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under a name of our own."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


@query(
    "sweeps",
    """SELECT turn, r_name AS name, CASE WHEN turn = 1 OR (turn = 3 AND r_regionkey = 0) THEN 'arriving' WHEN turn = 2 OR (turn = 4 AND r_regionkey = 0) THEN 'do' ELSE 'already done' END AS verdict FROM region, range(1, 5) t(turn)""",
)
def sweeps(spark, d):
    """A file for each region; they are seen, handled once, and one that is written anew is handled again."""
    at, state = folder(spark, "in"), folder(spark, "state")
    names = {r["r_regionkey"]: r["r_name"] for r in table(spark, d, "region").collect()}  # five
    for name in names.values():
        put(spark, f"{at}/{name}", name)
    watched = arrivals.Folder(spark, at, state)
    handle = lambda todo: todo.select("path", F.lit("done").alias("outcome"))
    looks = []
    for turn in (1, 2, 3, 4):
        if turn == 3:
            put(spark, f"{at}/{names[0]}", "longer than it was before")
        looks.append(written(watched.sweep(turn, handle).select(F.lit(turn).cast("long").alias("turn"), F.substring_index("path", "/", -1).alias("name"), "verdict"), "looks"))
    return looks[0].unionAll(looks[1]).unionAll(looks[2]).unionAll(looks[3])


@query(
    "followed_files",
    """SELECT turn, r_name AS name, CASE WHEN turn = 4 THEN 25 ELSE length(r_name) END AS size FROM region, range(1, 5) t(turn) WHERE turn = 2 OR (turn = 4 AND r_regionkey = 0)""",
)
def followed_files(spark, d):
    """The same as a stream of looks with state by path, in three runs from one checkpoint."""
    at, state = folder(spark, "in"), folder(spark, "state")
    names = {r["r_regionkey"]: r["r_name"] for r in table(spark, d, "region").collect()}  # five
    for name in names.values():
        put(spark, f"{at}/{name}", name)
    watched = arrivals.Folder(spark, at, state)
    handle = lambda todo: todo.select("path", F.lit("done").alias("outcome"))
    for turn in (1, 2, 3, 4):
        if turn == 3:
            put(spark, f"{at}/{names[0]}", "longer than it was before")
        watched.look(turn)
        if turn != 1:
            watched.follow(handle).awaitTermination()
    return watched.handled().select(F.col("at").cast("long").alias("turn"), F.substring_index("path", "/", -1).alias("name"), "size")


@query("folder_listing", """SELECT r_name AS name, length(r_name) AS size FROM region""")
def folder_listing(spark, d):
    at = folder(spark, "in")
    for r in table(spark, d, "region").select("r_name").collect():  # five
        put(spark, f"{at}/{r['r_name']}", r["r_name"])
    return files.listing(spark, at).select(F.substring_index("path", "/", -1).alias("name"), "size")
