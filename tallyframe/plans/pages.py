"""Merged pages, paired sheets, differences of inked pages, sizes of lines: orders as jobs, line items as files and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import faces, pages
from tallyframe.operators.tables import parts_for, written
from tallyframe.plans.registry import query, table

FILES = """f AS (SELECT l_orderkey AS job, l_linenumber * 100000 + l_partkey AS pos, 'f' || (l_linenumber * 100000 + l_partkey) AS file, min(l_partkey % 40) AS digest, CASE WHEN min(l_partkey) % 40 = 0 THEN 0 ELSE 1 + min(l_partkey) % 3 END AS n,
              max(CASE WHEN l_suppkey % 20 = 0 THEN 612.0 ELSE 595 + l_quantity % 2 * 0.9 END)::DOUBLE AS width, min(l_quantity) AS content FROM lineitem GROUP BY 1, 2),
  p AS (SELECT job, pos, unnest(range(1, n + 1)) AS page, width, 842.0::DOUBLE AS height, content FROM f),
  one AS (SELECT job, page, arg_min(width, pos) AS w, min(pos) AS "first" FROM p GROUP BY 1, 2),
  r0 AS (SELECT job, CASE WHEN count(*) < 2 THEN 'too few' ELSE 'blank' END AS why, NULL::BIGINT AS page, NULL::BIGINT AS "first", CASE WHEN count(*) >= 2 THEN min(pos) FILTER (n = 0) END AS other FROM f GROUP BY job HAVING count(*) < 2 OR count(*) FILTER (n = 0) > 0),
  r1 AS (SELECT job, 'different paper' AS why, page, "first", pos AS other FROM p JOIN one USING (job, page) WHERE abs(width - w) > 1 AND job NOT IN (SELECT job FROM r0) QUALIFY row_number() OVER (PARTITION BY job ORDER BY page, pos) = 1),
  refused AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1)"""


def merge_jobs(spark, d):
    pos = F.col("l_linenumber") * 100_000 + F.col("l_partkey")
    width = F.when(F.col("l_suppkey") % 20 == 0, 612.0).otherwise(595 + F.col("l_quantity") % 2 * 0.9)
    part = F.min("l_partkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), pos.alias("pos"), "l_partkey", width.alias("width"), "l_quantity")
    f = lines.repartition(parts_for(spark, lines.count()), "job", "pos").groupBy("job", "pos").agg((part % 40).alias("digest"), F.when(part % 40 == 0, 0).otherwise(1 + part % 3).alias("n"), F.max("width").alias("width"), F.min("l_quantity").alias("content"))
    f = written(f, "files")
    f = f.repartition(parts_for(spark, f.count()), "job", "pos").withColumn("file", F.concat(F.lit("f"), F.col("pos").cast("string")))
    laid = f.filter("n > 0").select("job", "pos", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("page"), "width", F.lit(842.0).alias("height"), "content")
    return pages.merged(f.select("job", "pos", "file", "digest"), laid)


@query("merged_pages", f"""WITH {FILES} SELECT job, page, pos, content, w AS width, height FROM p JOIN one USING (job, page) WHERE job NOT IN (SELECT job FROM refused)""")
def merged_pages(spark, d):
    return merge_jobs(spark, d)[0]


@query("merge_refusals", f"""WITH {FILES} SELECT * FROM refused""")
def merge_refusals(spark, d):
    return merge_jobs(spark, d)[1]


@query("merge_report", f"""WITH {FILES} SELECT job, file, n AS n_pages, n < max(n) OVER (PARTITION BY job) AS is_short, CASE WHEN min(pos) OVER (PARTITION BY job, digest) < pos THEN first_value(file) OVER (PARTITION BY job, digest ORDER BY pos) END AS same_as FROM f WHERE job NOT IN (SELECT job FROM refused)""")
def merge_report(spark, d):
    return merge_jobs(spark, d)[2]


@query(
    "paired_sheets",
    """WITH n AS (SELECT l_orderkey AS job, max(l_linenumber) AS sheets FROM lineitem GROUP BY 1), k AS (SELECT *, CASE job % 4 WHEN 0 THEN 1 WHEN 3 THEN 1 + job // 4 % 5 ELSE sheets END AS pages FROM n)
       SELECT job, unnest(range(1, sheets + 1)) AS sheet, CASE WHEN pages = 1 THEN 1 ELSE unnest(range(1, sheets + 1)) END AS page, NULL AS why FROM k WHERE pages = 1 OR pages = sheets
       UNION ALL SELECT job, NULL, NULL, sheets || ' sheets, ' || pages || ' pages' FROM k WHERE pages <> 1 AND pages <> sheets""",
)
def paired_sheets(spark, d):
    """Runs of sheets, with one page for all of them, a page each, or a number that doesn't go with them."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.max("l_linenumber").cast("long").alias("sheets"))
    k = F.col("job") % 4
    n = n.withColumn("pages", F.when(k == 0, 1).when(k == 3, 1 + F.floor(F.col("job") / 4) % 5).otherwise(F.col("sheets")))
    each = lambda count, name: n.select("job", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long"))).alias(name))
    return pages.paired(each("sheets", "sheet"), each("pages", "page"))


CELLS = "SELECT DISTINCT l_suppkey % 8 AS page, (l_orderkey * 7 % 300)::BIGINT AS x, (l_partkey * 13 % 200)::BIGINT AS y FROM lineitem WHERE l_returnflag = '{}'"


def side_sql(name: str, a: str, b: str) -> str:
    return f"SELECT page, '{name}' AS side, y, min(x) AS x0, max(x) AS x1 FROM (SELECT page, x, y, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS i FROM {a} WHERE NOT EXISTS (SELECT 1 FROM {b} WHERE {a}.page = {b}.page AND abs({a}.x - {b}.x) <= 2 AND abs({a}.y - {b}.y) <= 2)) GROUP BY page, y, i"


@query(
    "page_differences",
    f"""WITH a AS (SELECT * FROM ({CELLS.format("A")}) WHERE x % 3 = 0 AND x < 280 AND y < 180), b AS (SELECT * FROM ({CELLS.format("R")}) WHERE x < 280 AND y < 180) {side_sql("added", "b", "a")} UNION ALL {side_sql("removed", "a", "b")}""",
)
def page_differences(spark, d):
    """Two states of eight pages that differ in size, as stretches."""
    cells = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("page"), (F.col("l_orderkey") * 7 % 300).alias("x"), (F.col("l_partkey") * 13 % 200).alias("y"), "l_returnflag")
    before, now = cells.filter("l_returnflag = 'A' AND x % 3 = 0"), cells.filter("l_returnflag = 'R'")
    sizes = lambda w, h: cells.select("page").distinct().select("page", F.lit(w).alias("width"), F.lit(h).alias("height"))
    return pages.differences(pages.runs_of(before), pages.runs_of(now), 2, sizes(280, 190), sizes(300, 180))


#: Letters by how high they are in capitals, and how wide for their height.
SHAPES = [("x", 0.70, 0.95), ("l", 1.05, 0.25), ("T", 1.00, 0.85), ("i", 0.97, 0.22), ("o", 0.72, 1.05), ("f", 1.04, 0.45), ("I", 1.00, 0.20)]
MARKS = f"""shapes(i, glyph, tall, own) AS (VALUES {", ".join(f"({i}, '{g}', {t}::DOUBLE, {o}::DOUBLE)" for i, (g, t, o) in enumerate(SHAPES))}),
  m AS (SELECT row_number() OVER () AS k, l_orderkey, l_linenumber, l_partkey, l_suppkey AS line, tall * (2 + l_suppkey % 5 * 0.5::DOUBLE) * (1 + (l_partkey % 7 - 3) * 0.004::DOUBLE) AS h, own + (l_partkey % 5 - 2) * 0.01::DOUBLE AS form
        FROM lineitem JOIN shapes ON i = CASE WHEN l_suppkey % 3 = 0 THEN (l_orderkey + l_linenumber) % 2 * 2 WHEN l_suppkey % 3 = 1 THEN (l_orderkey + l_linenumber) % 2 * 4 ELSE (l_orderkey + l_linenumber) % 7 END),
  c0 AS (SELECT line, v[3 * len(v) // 4 + 1] / 1.05::DOUBLE AS c FROM (SELECT line, list_sort(list(h)) AS v FROM m GROUP BY 1))"""


def matched_sql(sizes: str) -> str:
    return f"SELECT m.k, m.line, any_value(h) AS h, any_value(c) AS c, min(struct_pack(off := abs(h / c - tall) + abs(form - own), glyph := glyph, tall := tall)) AS b FROM m JOIN {sizes} USING (line), shapes GROUP BY m.k, m.line"


@query(
    "scale_passes",
    f"""WITH {MARKS}, m1 AS ({matched_sql("c0")}),
      s AS (SELECT line, list_sort(list(h / b.tall)) AS v FROM m1 WHERE exp(-((b.off / 0.2) ** 2)) >= 0.7 GROUP BY 1),
      c1 AS (SELECT line, CASE WHEN len(v) >= 3 AND abs(v[len(v) // 2 + 1] - c) / c >= 0.02 THEN v[len(v) // 2 + 1] ELSE c END AS c FROM c0 LEFT JOIN s USING (line)),
      m2 AS ({matched_sql("c1")})
    SELECT l_orderkey, l_linenumber, l_partkey, b.glyph AS glyph, round(exp(-((b.off / 0.2) ** 2)), 6) AS confidence, round(c, 6) AS capital FROM m2 JOIN m USING (k)""",
)
def scale_passes(spark, d):
    """Lines of which a third have no letter taller than a capital, and a third none as tall: the first guess is wrong there."""
    at = F.col("l_orderkey") + F.col("l_linenumber")
    which = F.when(F.col("l_suppkey") % 3 == 0, at % 2 * 2).when(F.col("l_suppkey") % 3 == 1, at % 2 * 4).otherwise(at % 7)
    of = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in SHAPES]), (which + 1).cast("int"))
    height = of(1) * (2 + F.col("l_suppkey") % 5 * 0.5) * (1 + (F.col("l_partkey") % 7 - 3) * 0.004)
    marks = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("line"), height.alias("h"), (of(2) + (F.col("l_partkey") % 5 - 2) * 0.01).alias("form"))
    got = faces.scaled_lines(marks, "line", "h", "form", SHAPES, 1.05)
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "glyph", F.round("confidence", 6).alias("confidence"), F.round("capital", 6).alias("capital"))
