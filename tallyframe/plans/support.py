"""Smaller computations: greedy groupings, layouts, symbols, counts, lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions import drawings, measure
from tallyframe.functions.faces import EXTRA, measurable
from tallyframe.functions.symbols import code128
from tallyframe.operators import greedy, sequence
from tallyframe.plans.registry import query, table


#: Marks on a page: a hundred, whatever the size of the table.
ON_PAGE = 100


@query(
    "lines_by_overlap",
    """WITH RECURSIVE m AS (SELECT p_partkey // 100 AS page, p_partkey, p_retailprice * (p_partkey * 7 % 30 + 1) / 100 AS t, p_retailprice * (p_partkey * 7 % 30 + 1) / 100 + p_size AS b, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) AS i FROM part),
            r AS (SELECT page, i, [{'o': p_partkey, 't': t, 'b': b, 'line': 1}] AS held FROM m WHERE i = 1
                  UNION ALL SELECT m.page, m.i, list_append(held, {'o': m.p_partkey, 't': m.t, 'b': m.b, 'line': coalesce(
                         list_max(list_transform(list_filter(held, lambda x: (least(x.b, m.b) - greatest(x.t, m.t)) / least(x.b - x.t, m.b - m.t) > 0.35), lambda x: x.line)), list_max(list_transform(held, lambda x: x.line)) + 1)})
                  FROM r JOIN m ON m.page = r.page AND m.i = r.i + 1)
       SELECT page, h.o AS p_partkey, h.line AS line FROM (SELECT page, unnest(held) AS h FROM r QUALIFY row_number() OVER (PARTITION BY page ORDER BY i DESC) = 1)""",
)
def lines_by_overlap(spark, d):
    top = F.col("p_retailprice") * (F.col("p_partkey") * 7 % 30 + 1) / 100
    marks = table(spark, d, "part").select(F.floor(F.col("p_partkey") / ON_PAGE).alias("page"), "p_partkey", top.alias("t"), (top + F.col("p_size")).alias("b"))
    return greedy.lines_by_overlap(marks, "page", "p_partkey", "t", "b")


@query(
    "stacked_marks",
    """WITH RECURSIVE m AS (SELECT p_partkey // 100 AS page, p_partkey AS o, p_size::DOUBLE AS x, p_retailprice * (p_partkey * 7 % 30 + 1) / 500 AS y, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) AS i FROM part),
            r AS (SELECT page, i, [{'first': o, 'n': 1, 'x0': x, 'x1': x, 'y0': y, 'y1': y}] AS held FROM m WHERE i = 1
                  UNION ALL SELECT page, i, CASE WHEN f IS NULL THEN list_append(held, {'first': o, 'n': 1, 'x0': x, 'x1': x, 'y0': y, 'y1': y}) ELSE list_transform(held, lambda b: CASE WHEN b.first = f
                         THEN {'first': b.first, 'n': b.n + 1, 'x0': least(b.x0, x), 'x1': greatest(b.x1, x), 'y0': least(b.y0, y), 'y1': greatest(b.y1, y)} ELSE b END) END
                  FROM (SELECT m.*, held, list_min(list_transform(list_filter(held, lambda b: m.x >= b.x0 - 2 AND m.x <= b.x1 + 2 AND m.y >= b.y0 - 2 AND m.y <= b.y1 + 2), lambda b: b.first)) AS f FROM r JOIN m ON m.page = r.page AND m.i = r.i + 1))
       SELECT page, h.first AS first, h.n AS n, h.x0 AS x0, h.x1 AS x1, h.y0 AS y0, h.y1 AS y1 FROM (SELECT page, unnest(held) AS h FROM r QUALIFY row_number() OVER (PARTITION BY page ORDER BY i DESC) = 1)""",
)
def stacked_marks(spark, d):
    y = F.col("p_retailprice") * (F.col("p_partkey") * 7 % 30 + 1) / 500
    marks = table(spark, d, "part").select(F.floor(F.col("p_partkey") / ON_PAGE).alias("page"), "p_partkey", F.col("p_size").alias("x"), y.alias("y"))
    return greedy.stacked(marks, "page", "p_partkey", "x", "y", 2.0, 2.0)


def kept_one_by_one(rows: str, near: str) -> str:
    """SQL of rows (g, o, x, y) that are near none kept before them in their group; `near` compares k (kept) with m."""
    return f"""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o) AS i FROM ({rows})),
            r AS (SELECT g, i, [{{'o': o, 'x': x, 'y': y}}] AS kept FROM m WHERE i = 1
                  UNION ALL SELECT m.g, m.i, CASE WHEN len(list_filter(kept, lambda k: {near})) > 0 THEN kept ELSE list_append(kept, {{'o': m.o, 'x': m.x, 'y': m.y}}) END FROM r JOIN m ON m.g = r.g AND m.i = r.i + 1),
            e AS (SELECT g, unnest(kept) AS k FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1)"""


@query(
    "distinct_shapes",
    kept_one_by_one("SELECT p_brand AS g, p_partkey AS o, p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part", "abs(k.x - m.x) <= 1.5 AND abs(k.y - m.y) <= 1.5") + " SELECT g AS p_brand, k.o AS p_partkey, k.x AS h, k.y AS a FROM e",
)
def distinct_shapes(spark, d):
    shapes = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("h"), (F.col("p_retailprice") / 100).alias("a"))
    return greedy.distinct_shapes(shapes, "p_brand", "p_partkey", ["h", "a"], 1.5)


@query(
    "code128",
    """WITH t AS (SELECT p_partkey, p_partkey::VARCHAR AS k FROM part), c AS (SELECT *, length(k) - length(k) % 2 AS even, length(k) >= 4 AS long FROM t),
            v AS (SELECT p_partkey, [ascii('P') - 32, ascii('-') - 32] || CASE WHEN long THEN CASE WHEN length(k) % 2 = 1 THEN [ascii(k) - 32] ELSE [] END || [99] || list_transform(range(0, even // 2), lambda j: substr(k, length(k) - even + 2 * j + 1, 2)::INT) || [100]
                         ELSE list_transform(string_split(k, ''), lambda x: ascii(x) - 32) END || [ascii('A') - 32] AS body FROM c)
       SELECT p_partkey, [104] || body || [(104 + list_sum(list_transform(body, lambda x, i: x * i)))::INT % 103, 106] AS symbols FROM v""",
)
def code128_symbols(spark, d):
    return table(spark, d, "part").select("p_partkey", code128(F.concat(F.lit("P-"), F.col("p_partkey").cast("string"), F.lit("A"))).alias("symbols"))


@query("code128_checksums", """SELECT p_partkey, (104 + list_sum(list_transform(range(1, length(t) + 1), lambda i: i * (ascii(substr(t, i, 1)) - 32))))::BIGINT % 103 AS checksum FROM (SELECT p_partkey, p_name AS t FROM part)""")
def code128_checksums(spark, d):
    from tallyframe.functions.symbols import checksum

    values = F.transform(F.sequence(F.lit(1), F.length("p_name")), lambda i: F.ascii(F.substr(F.col("p_name"), i, F.lit(1))) - 32)
    return table(spark, d, "part").select("p_partkey", checksum(F.lit(104), values).cast("long").alias("checksum"))


@query("next_numbers", """SELECT coalesce(max(o_orderkey) + 1, 1) AS next FROM orders""")
def next_numbers(spark, d):
    return sequence.next_number(table(spark, d, "orders"), "o_orderkey")


@query("text_records", """SELECT event_id, nullif(json_extract_string(props, '$.k'), '') AS k, CASE WHEN event_type = 'view' THEN replace('ipps://h/' || user_id, 'ipps://', 'ipp://') ELSE 'ipps://h/' || user_id END AS uri FROM events""")
def text_records(spark, d):
    uri = F.concat(F.lit("ipps://h/"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.nullif(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.when(F.col("event_type") == "view", F.replace(uri, F.lit("ipps://"), F.lit("ipp://"))).otherwise(uri).alias("uri"))


@query("feed_answers", """SELECT p_partkey, CASE upper(trim(w)) WHEN 'SAME' THEN 'same' WHEN 'TURNED' THEN 'turned' END AS feed FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' same' WHEN 1 THEN 'Turned ' ELSE p_name END AS w FROM part)""")
def feed_answers(spark, d):
    k = F.col("p_partkey") % 3
    word = F.upper(F.trim(F.when(k == 0, " same").when(k == 1, "Turned ").otherwise(F.col("p_name"))))
    return table(spark, d, "part").select("p_partkey", F.when(word == "SAME", "same").when(word == "TURNED", "turned").alias("feed"))


DRAWINGS = """d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['line', 'rect', 'ellipse', 'path'][l_partkey % 4 + 1] AS kind, l_quantity::DOUBLE AS a, l_tax * 100::DOUBLE AS b, l_discount * 200 - 10::DOUBLE AS c, l_quantity / 2 - 8::DOUBLE AS d, l_suppkey % 3 / 2::DOUBLE AS w,
       list_transform(range(0, l_suppkey % 4), lambda i: {'x': l_quantity * (i + 1) % 37, 'y': l_tax * 100 + i * i}) AS pts FROM lineitem),
  e AS (SELECT *, CASE kind WHEN 'line' THEN least(a, c) WHEN 'rect' THEN least(a, a + c) WHEN 'ellipse' THEN a - abs(c) ELSE coalesce(list_min([p.x for p in pts]), 0) END - w / 2 AS x0, CASE kind WHEN 'line' THEN least(b, d) WHEN 'rect' THEN least(b, b + d) WHEN 'ellipse' THEN b - abs(d) ELSE coalesce(list_min([p.y for p in pts]), 0) END - w / 2 AS y0,
       CASE kind WHEN 'line' THEN greatest(a, c) WHEN 'rect' THEN greatest(a, a + c) WHEN 'ellipse' THEN a + abs(c) ELSE coalesce(list_max([p.x for p in pts]), 0) END + w / 2 AS x1, CASE kind WHEN 'line' THEN greatest(b, d) WHEN 'rect' THEN greatest(b, b + d) WHEN 'ellipse' THEN b + abs(d) ELSE coalesce(list_max([p.y for p in pts]), 0) END + w / 2 AS y1 FROM d)"""


def drawn(spark, d):
    """Drawings of four kinds, some of them paths of too few points, on the pages of a document."""
    q, t, s = F.col("l_quantity").cast("double"), F.col("l_tax") * 100, F.col("l_suppkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("line", "rect", "ellipse", "path")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    steps = F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < s % 4)
    points = F.transform(steps, lambda i: F.struct((q * (i + 1) % 37).alias("x"), (t + i * i).alias("y")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s, kind.alias("kind"), q.alias("a"), t.alias("b"), (F.col("l_discount") * 200 - 10).alias("c"), (q / 2 - 8).alias("d"), (s % 3 / 2).alias("w"), points.alias("pts"))
    return rows.withColumn("box", drawings.bounds(*[F.col(c) for c in ("kind", "a", "b", "c", "d", "pts", "w")]))


@query("shape_bounds", f"WITH {DRAWINGS} SELECT l_orderkey, l_linenumber, l_partkey, kind, " + ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("x0", "y0", "x1", "y1")) + " FROM e")
def shape_bounds(spark, d):
    return drawn(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "kind", *[F.round(f"box.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("image_specs", """SELECT p_partkey, 'a:b/' || p_name AS file, p_size::DOUBLE AS x, 7.5::DOUBLE AS y, p_size * 2.0::DOUBLE AS w, CASE WHEN p_partkey % 2 = 0 THEN 30.0 ELSE p_size * 1.5 END::DOUBLE AS h FROM part""")
def image_specs(spark, d):
    spec = F.concat(F.lit("a:b/"), F.col("p_name"), F.lit(":"), F.col("p_size").cast("string"), F.lit(",7.5:"), (F.col("p_size") * 2).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "x30").otherwise(""))
    got = lambda i: F.regexp_extract(spec, r"^(.*):([-0-9.]+),([-0-9.]+):([0-9.]+)(?:x([0-9.]+))?$", i)
    w = got(4).cast("double")
    return table(spark, d, "part").select("p_partkey", got(1).alias("file"), got(2).cast("double").alias("x"), got(3).cast("double").alias("y"), w.alias("w"), F.coalesce(F.nullif(got(5), F.lit("")).cast("double"), w * 0.75).alias("h"))


@query("placement_specs", """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS x, CASE WHEN p_partkey % 3 <> 0 THEN 2.5::DOUBLE END AS y, CASE WHEN p_partkey % 3 <> 0 THEN 'a: b' || chr(10) || p_name END AS words FROM part""")
def placement_specs(spark, d):
    spec = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.col("p_size").cast("string"), F.lit(",2.5:a: b\\n"), F.col("p_name"))).otherwise(F.concat(F.lit("x,1:"), F.col("p_name")))
    got = lambda i: F.regexp_extract(spec, r"(?s)^([^,:]*),([^:]*):(.*)$", i)
    x, y = got(1).try_cast("double"), got(2).try_cast("double")
    good = x.isNotNull() & y.isNotNull() & (F.trim(got(3)) != "")
    words = F.replace(F.replace(got(3), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    return table(spark, d, "part").select("p_partkey", F.when(good, x).alias("x"), F.when(good, y).alias("y"), F.when(good, words).alias("words"))


@query("key_values", """SELECT p_partkey, 'name' AS key, p_name || '=x' AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part""")
def key_values(spark, d):
    pairs = F.array(F.concat(F.lit("name="), F.col("p_name"), F.lit("=x")), F.concat(F.lit("size="), F.col("p_size").cast("string")))
    each = table(spark, d, "part").select("p_partkey", F.explode(pairs).alias("p"))
    return each.select("p_partkey", F.split("p", "=", 2)[0].alias("key"), F.split("p", "=", 2)[1].alias("value"))


@query("named_sizes", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'A4' WHEN 1 THEN 'Letter' END AS name FROM part""")
def named_sizes(spark, d):
    k = F.col("p_partkey") % 3
    w, h = F.when(k == 0, 210.3).when(k == 1, 215.7).otherwise(100.0), F.when(k == 0, 296.8).when(k == 1, 279.0).otherwise(100.0)
    name = F.lit(None).cast("string")
    for n, sw, sh in reversed(measure.SHEETS):
        name = F.when(measure.near(w, F.lit(sw), 0.5) & measure.near(h, F.lit(sh), 0.5), n).otherwise(name)
    return table(spark, d, "part").select("p_partkey", name.alias("name"))


@query("coverage_verdicts", """SELECT l_suppkey, CASE WHEN m >= 0.53 THEN 'bold' WHEN m <= 0.48 THEN 'regular' ELSE 'unchanged' END AS weight FROM (SELECT l_suppkey, v[len(v) // 2 + 1] AS m FROM (SELECT l_suppkey, list_sort(list(0.5 + (l_quantity - 25) / 200)) AS v FROM lineitem GROUP BY 1) WHERE len(v) >= 8)""")
def coverage_verdicts(spark, d):
    from tallyframe.operators.fits import indexed_quantiles

    values = table(spark, d, "lineitem").select("l_suppkey", (0.5 + (F.col("l_quantity") - 25) / 200).alias("v"))
    m = indexed_quantiles(values, ["l_suppkey"], "v").filter("n >= 8")
    return m.select("l_suppkey", F.when(F.col("median") >= 0.53, "bold").when(F.col("median") <= 0.48, "regular").otherwise("unchanged").alias("weight"))


@query("delta_pages", """SELECT l_orderkey, sum(l_quantity) AS added FROM lineitem a WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = a.l_orderkey AND r.l_returnflag = 'R') GROUP BY 1""")
def delta_pages(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    reprinted = lines.filter("l_returnflag = 'R'").select("l_orderkey").distinct()
    return lines.filter("l_returnflag = 'A'").join(reprinted, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("added"))


@query("progress", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN round((o_orderkey % 3) / (o_orderkey % 4)::DOUBLE, 6) END AS share FROM orders""")
def progress(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.try_divide(F.col("o_orderkey") % 3, F.col("o_orderkey") % 4), 6).alias("share"))


@query("repeat_plan", """SELECT c_custkey, s.i AS sheet, (s.i - 1) * 3 + c.i AS item FROM customer, range(1, 4) s(i), range(1, 4) c(i)""")
def repeat_plan(spark, d):
    # Sheets and items of a row follow from numbers alone.
    sheets = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>")).alias("sheet"))
    return sheets.select("c_custkey", "sheet", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (F.col("sheet") - 1) * 3 + i)).alias("item"))


@query(
    "document_faults",
    f"""WITH {DRAWINGS}, f AS (
         SELECT l_orderkey, l_linenumber, l_partkey, 'text' AS what, CASE WHEN l_suppkey % 17 = 0 THEN 'position' WHEN l_tax * 60000 - 100 <= 0 OR l_tax * 60000 - 100 > 4000 THEN 'size' WHEN l_linenumber > 5 THEN 'page' END AS fault FROM lineitem
         UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, kind, CASE WHEN l_linenumber > 5 THEN 'page' WHEN w - 0.25 < 0 AND l_suppkey % 7 = 0 THEN 'width' WHEN l_suppkey % 5 = 0 THEN 'nothing to see' WHEN l_suppkey % 5 = 1 AND l_partkey % 3 = 0 THEN 'colour' WHEN kind = 'path' AND len(pts) < 2 THEN 'points' END FROM e)
       SELECT * FROM f WHERE fault IS NOT NULL""",
)
def document_faults(spark, d):
    """Placed texts and drawings of documents of five pages that can't be printed as they are, and why."""
    pages, s = F.lit(5), F.col("l_suppkey")
    x = F.when(s % 17 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity").cast("double"))
    texts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("text").alias("what"), drawings.text_fault(x, F.col("l_tax"), F.col("l_tax") * 60_000 - 100, F.col("l_linenumber"), pages).alias("fault"))
    stroke = F.when(s % 5 == 0, None).when((s % 5 == 1) & (F.col("l_partkey") % 3 == 0), "#12x").when(s % 5 < 4, "#a0b1c2")
    fill = F.when(s % 5 == 4, "#fff")
    width = F.when(s % 7 == 0, F.col("w") - 0.25).otherwise(F.col("w"))
    fault = drawings.drawing_fault(F.col("kind"), F.col("box"), F.col("pts"), width, stroke, fill, F.col("l_linenumber"), pages)
    return texts.unionByName(drawn(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.col("kind").alias("what"), fault.alias("fault"))).filter("fault IS NOT NULL")


@query("monotone_ids", """SELECT s_suppkey, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY s_suppkey) AS id FROM supplier""")
def monotone_ids(spark, d):
    last = table(spark, d, "nation").agg(F.max("n_nationkey").alias("last"))
    numbered = sequence.numbered(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    return numbered.crossJoin(last).select("s_suppkey", (F.col("last") + F.col("number")).alias("id"))  # one row


@query("steps_back", """SELECT user_id, least(count(*) - 1, 10) AS back FROM events GROUP BY 1""")
def steps_back(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.least(F.count("*") - 1, F.lit(10)).alias("back"))


@query("measurable_words", r"""SELECT doc_id, count(*) AS words, sum(length(w))::BIGINT AS letters FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \n\t\r]+')) AS w FROM documents) WHERE regexp_full_match(w, '[\p{L}\p{N}]{2,}') AND regexp_full_match(w, '[\x20-\x7E\xA0-\xFF""" + "".join(EXTRA.values()) + r"""]*') GROUP BY 1""")
def measurable_words(spark, d):
    """Words of letters and figures only, two or more, that the faces can write."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \n\t\r]+"), 0)).alias("w"))
    return words.filter(measurable(F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("words"), F.sum(F.char_length("w")).alias("letters"))


def leaning(around: str, out: str, step: float, reach: int) -> str:
    """SQL of the angle, within so many steps of each page's (page, d0), at which its points fall into the fewest rows."""
    return f"""{out} AS (SELECT page, arg_max(degrees, s * 1e6 - degrees) AS d0 FROM (
              SELECT page, degrees, sum(c * c) AS s FROM (SELECT p.page, degrees, floor(y * cos(radians(degrees)) - x * sin(radians(degrees))) AS row, count(*) AS c
                FROM p JOIN (SELECT page, round(d0 + i * {step}, 6) AS degrees FROM {around}, range(-{reach}, {reach} + 1) t(i)) a ON a.page = p.page GROUP BY ALL) GROUP BY ALL) GROUP BY page)"""


@query(
    "leaning_pages",
    "WITH p AS (SELECT l_suppkey % 4 AS page, (l_partkey % 200)::DOUBLE AS x, (l_orderkey % 20) * 10 + 2.5::DOUBLE + (l_partkey % 200) * 0.02::DOUBLE AS y FROM lineitem), z AS (SELECT DISTINCT page, 0.0::DOUBLE AS d0 FROM p), " + leaning("z", "c", 0.25, 12) + ", " + leaning("c", "f", 0.02, 12) + " SELECT page, d0 AS degrees FROM f",
)
def leaning_pages(spark, d):
    from tallyframe.operators.fits import leaning

    x = (F.col("l_partkey") % 200).cast("double")
    pages = table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("page"), x.alias("x"), ((F.col("l_orderkey") % 20) * 10 + 2.5 + x * 0.02).alias("y"))
    return leaning(pages, ["page"], "x", "y", 3.0)


@query("durations", """SELECT o_orderkey, CASE WHEN s < 90 THEN s || ' s' WHEN m < 90 THEN m || ' min' ELSE (m // 60) || ' h ' || (m % 60) || ' min' END AS said FROM (SELECT o_orderkey, s, round(s / 60.0)::BIGINT AS m FROM (SELECT o_orderkey, (o_orderkey * 31) % 20000 AS s FROM orders))""")
def durations(spark, d):
    from tallyframe.functions.options import duration

    return table(spark, d, "orders").select("o_orderkey", duration(F.col("o_orderkey") * 31 % 20_000).alias("said"))
