"""Checks over the standard tables: pages are made of line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import checks, rules
from tallyframe.operators.tables import written
from tallyframe.plans.registry import query, table

W, H = 210.0, 297.0


def regions(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), (F.col("l_quantity") * 4).alias("x0"), (F.col("l_tax") * 1000).alias("y0"), (F.col("l_quantity") * 4 + 12).alias("x1"), (F.col("l_tax") * 1000 + 150).alias("y1"),
        (F.col("l_discount") * 10).alias("removed"), (F.col("l_tax") * 1000).alias("top"), (F.col("l_discount") * 5).alias("dark"), (F.col("l_quantity") / 5).alias("clearance"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )


#: Where a row lies in the table.
PLACE = ["file", "row"]


R = """r AS (SELECT l_orderkey AS page, l_quantity * 4 AS x0, l_tax * 1000 AS y0, l_quantity * 4 + 12 AS x1, l_tax * 1000 + 150 AS y1, l_discount * 10 AS removed, l_tax * 1000 AS top, l_discount * 5 AS dark, l_quantity / 5 AS clearance FROM lineitem)"""
S = {
    "moved": "SELECT 'blocker' AS severity, 'reflow' AS code, page, round(min(top) FILTER (removed > 0), 3)::DOUBLE AS detail FROM r GROUP BY page HAVING sum(removed) >= 1.5",
    "margin": "SELECT 'warning', 'margin', page, round(min(least(x0, y0, 210 - x1, 297 - y1)), 3)::DOUBLE FROM r GROUP BY page HAVING min(least(x0, y0, 210 - x1, 297 - y1)) < 5",
    "legible": "SELECT 'warning', 'legibility', page, round(max(dark), 3)::DOUBLE FROM r GROUP BY page HAVING max(dark) >= 0.35",
    "slack": "SELECT 'note', 'slack', page, round(min(clearance), 3)::DOUBLE FROM r GROUP BY page HAVING min(clearance) < 2",
}


def as_number(df):
    return df.withColumn("detail", F.col("detail").cast("double"))


def all_regions(spark, d):
    r = regions(spark, d)
    return rules.gathered([rules.moved_content(r, PLACE), rules.margins(r, 5.0, W, H), rules.legibility(r), rules.slack(r)])


@query("check_moved", f"WITH {R} {S['moved']}")
def check_moved(spark, d):
    return as_number(rules.moved_content(regions(spark, d), PLACE))


@query("check_regions", f"WITH {R} " + " UNION ALL ".join(S.values()))
def check_regions(spark, d):
    return as_number(all_regions(spark, d))


#: Orders as jobs, their line numbers as pages: sizes before and now, what is new and what is gone, and profiles.
JOBS = """n AS (SELECT l_orderkey AS job, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
  jobs AS (SELECT job, n, CASE WHEN job % 4 > 0 THEN 'p' || job % 4 END AS profile FROM n),
  b AS (SELECT job, unnest(range(1, n + (job % 7 > 0)::INT)) AS page, 210.0::DOUBLE AS width, 297.0::DOUBLE AS height FROM jobs),
  w AS (SELECT job, page, CASE WHEN (job + page) % 13 = 0 THEN 215.9 ELSE 210.2 END::DOUBLE AS width, 297.0::DOUBLE AS height FROM (SELECT job, unnest(range(1, n + (job % 11 > 0)::INT)) AS page FROM jobs)),
  a AS (SELECT l_orderkey AS job, l_linenumber AS page, l_quantity * 4 AS x0, l_tax * 1000 AS y0, l_quantity * 4 + 12 AS x1, l_tax * 1000 + 150 AS y1, l_extendedprice / 8 AS ink FROM lineitem WHERE l_orderkey % 5 > 0),
  g AS (SELECT l_orderkey AS job, l_linenumber AS page, l_tax * 1000 AS y0, l_discount * 25 AS ink FROM lineitem WHERE l_orderkey % 3 = 0 AND l_discount > 0),
  near AS (SELECT job, page, min(least(x0, y0, width - x1, height - y1)) AS near FROM a JOIN b USING (job, page) GROUP BY 1, 2),
  inked AS (SELECT job, page, sum(ink) / (210.0 * 297.0) AS share FROM a JOIN b USING (job, page) GROUP BY 1, 2),
  gone AS (SELECT job, coalesce(s, 0) AS gone FROM jobs LEFT JOIN (SELECT job, sum(ink) AS s FROM g GROUP BY 1) USING (job) WHERE job NOT IN (SELECT job FROM a)),
  every AS (
    SELECT job, CASE WHEN e > o THEN 'warning' ELSE 'blocker' END AS severity, CASE WHEN e > o THEN 'pages_added' ELSE 'pages_removed' END AS code, 0 AS page, abs(e - o)::DOUBLE AS detail
    FROM (SELECT job, (SELECT count(*) FROM b WHERE b.job = jobs.job) AS o, (SELECT count(*) FROM w WHERE w.job = jobs.job) AS e FROM jobs) WHERE e <> o
    UNION ALL SELECT job, 'blocker', 'page_size_mismatch', page, abs(b.width - w.width) FROM b JOIN w USING (job, page) WHERE abs(b.width - w.width) > 0.5
    UNION ALL SELECT job, 'blocker', 'reflow', page, min(y0) FROM g GROUP BY job, page HAVING sum(ink) >= 1.5
    UNION ALL SELECT job, 'warning', 'margin', page, greatest(near, 0) FROM near WHERE near < 5
    UNION ALL SELECT job, 'warning', 'large_delta', page, share FROM inked WHERE share >= 0.06
    UNION ALL SELECT job, 'blocker', CASE WHEN gone > 0 THEN 'documents_reversed' ELSE 'empty_delta' END, 0, CASE WHEN gone > 0 THEN gone END FROM gone
    UNION ALL SELECT job, 'note', CASE WHEN profile IS NULL THEN 'uncalibrated' ELSE 'calibrated' END, 0, NULL FROM jobs)"""


def all_checks(spark, d):
    """Every check of every job, and the jobs."""
    lines = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "job", "l_linenumber": "page"})
    job, page = F.col("job"), F.col("page")
    sizes = checks.by_job(written(checks.by_job(lines.select("job", "page")).groupBy("job").agg(F.max("page").alias("n")), "sizes"))
    jobs = sizes.select("job", F.when(job % 4 > 0, F.concat(F.lit("p"), job % 4)).alias("profile"))
    pages = lambda kept: sizes.select("job", F.explode(F.filter(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: i < F.col("n") + kept.cast("int"))).alias("page"))
    before = pages(job % 7 > 0).select("job", "page", F.lit(W).alias("width"), F.lit(H).alias("height"))
    now = pages(job % 11 > 0).select("job", "page", F.when((job + page) % 13 == 0, 215.9).otherwise(210.2).alias("width"), F.lit(H).alias("height"))
    x, y = F.col("l_quantity") * 4, F.col("l_tax") * 1000
    added = lines.filter(job % 5 > 0).select("job", "page", x.alias("x0"), y.alias("y0"), (x + 12).alias("x1"), (y + 150).alias("y1"), (F.col("l_extendedprice") / 8).alias("ink"))
    removed = lines.filter((job % 3 == 0) & (F.col("l_discount") > 0)).select("job", "page", y.alias("y0"), (F.col("l_discount") * 25).alias("ink"))
    return jobs, checks.everything(jobs, before, now, added, removed)


def told(df):
    return df.withColumn("detail", F.round("detail", 4))


@query("check_order", f"WITH {JOBS} SELECT job, severity, code, page, round(detail, 4) AS detail, row_number() OVER (PARTITION BY job ORDER BY CASE severity WHEN 'blocker' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, page, code) AS place FROM every")
def check_order(spark, d):
    return told(checks.to_read(all_checks(spark, d)[1]))


@query(
    "check_shape",
    """WITH b AS (SELECT o_orderkey AS page, 210.0 AS w, 297.0 AS h FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey AS page, CASE WHEN o_orderkey % 7 = 0 THEN 215.9 ELSE 210.2 END AS w, 297.0 AS h FROM orders WHERE o_orderkey % 3 <> 0),
            j AS (SELECT coalesce(b.page, n.page) AS page, b.page AS p0, n.page AS p1, b.w AS w0, n.w AS w1 FROM b FULL JOIN n ON b.page = n.page)
       SELECT 'warning' AS severity, 'pages_added' AS code, page FROM j WHERE p0 IS NULL UNION ALL SELECT 'blocker', 'pages_removed', page FROM j WHERE p1 IS NULL UNION ALL SELECT 'blocker', 'size_mismatch', page FROM j WHERE abs(w0 - w1) > 0.5""",
)
def check_shape(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("page"), F.when(k % 7 == 0, 215.9).otherwise(210.2).alias("other"), F.lit(H).alias("height"))
    before = o.filter("page % 5 <> 0").select("page", F.lit(W).alias("width"), "height")
    now = o.filter("page % 3 <> 0").select("page", F.col("other").alias("width"), "height")
    return rules.document_shape(before, now).drop("detail")


@query("check_coverage", """SELECT 'warning' AS severity, 'large_delta' AS code, l_orderkey AS page, round(sum(l_quantity) / 2000, 4)::DOUBLE AS detail FROM lineitem GROUP BY 1, 2, 3 HAVING sum(l_quantity) / 2000 >= 0.06""")
def check_coverage(spark, d):
    return as_number(rules.coverage(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg((F.sum("l_quantity") / 2000).alias("share"))))


@query("check_empty", """SELECT 'blocker' AS severity, 'documents_reversed' AS code, 0::BIGINT AS page FROM lineitem HAVING sum(l_quantity) > 0""")
def check_empty(spark, d):
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit(0.0).alias("added"), F.col("l_quantity").alias("removed"))
    return rules.emptiness(pages).drop("detail")


@query("check_symptoms", f"WITH {JOBS} SELECT job, severity, code, page FROM every e WHERE NOT (code IN ('reflow', 'heavy_coverage') AND EXISTS (SELECT * FROM every s WHERE s.job = e.job AND s.code = 'documents_reversed'))")
def check_symptoms(spark, d):
    return checks.without_symptoms(all_checks(spark, d)[1]).drop("detail")


@query("check_verdict", f"WITH {JOBS} SELECT job, count(*) FILTER (severity = 'blocker') > 0 AS blocked, count(*) FILTER (severity = 'blocker' AND code <> 'reflow') = 0 AS only_moved FROM every GROUP BY job")
def check_verdict(spark, d):
    return checks.verdicts(*all_checks(spark, d))


@query("check_split", f"WITH {JOBS} SELECT job, severity, code, page, round(detail, 4) AS detail FROM every WHERE code <> 'reflow' UNION ALL SELECT job, 'warning', 'reflow_split', 0, count(*) FROM every WHERE code = 'reflow' GROUP BY job")
def check_split(spark, d):
    return told(checks.split(all_checks(spark, d)[1]))


@query(
    "check_softened",
    f"WITH {R}, m AS ({S['moved']}) SELECT 'warning' AS severity, 'reprinted' AS code, 0::BIGINT AS page, count(*)::DOUBLE AS detail FROM m UNION ALL {S['slack']}",
)
def check_softened(spark, d):
    r = regions(spark, d)
    return as_number(rules.softened(rules.gathered([rules.moved_content(r, PLACE), rules.slack(r)])))


@query(
    "check_calibration",
    """WITH j AS (SELECT s_suppkey AS page, n_name AS profile, s_suppkey % 3 AS paper, n_regionkey % 3 AS profile_paper FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey)
       SELECT 'note' AS severity, 'not_calibrated' AS code, page FROM j WHERE profile IS NULL UNION ALL SELECT 'warning', 'other_paper', page FROM j WHERE profile IS NOT NULL AND paper <> profile_paper""",
)
def check_calibration(spark, d):
    profiles = table(spark, d, "nation").filter("n_nationkey % 2 = 0")
    jobs = table(spark, d, "supplier").join(profiles, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rules.calibration(jobs.select(F.col("s_suppkey").alias("page"), F.col("n_name").alias("profile"), (F.col("s_suppkey") % 3).alias("paper"), (F.col("n_regionkey") % 3).alias("profile_paper"))).drop("detail")


@query(
    "check_placements",
    """WITH l AS (SELECT l_orderkey AS page, l_quantity * 5 - 10 AS x, l_tax * 3700 AS y FROM lineitem)
       SELECT 'blocker' AS severity, 'off_page' AS code, page FROM l WHERE x < 0 OR y < 0 OR x > 210 OR y > 297
       UNION ALL SELECT 'warning', 'near_edge', page FROM l WHERE NOT (x < 0 OR y < 0 OR x > 210 OR y > 297) AND least(x, y, 210 - x, 297 - y) < 5""",
)
def check_placements(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") * 5 - 10).alias("x"), (F.col("l_tax") * 3700).alias("y"))
    return rules.placements(lines, 5.0, W, H).drop("detail")


@query(
    "document_rules",
    """SELECT doc_id, CASE WHEN n_chars < 100 THEN 'short' WHEN len(string_split(text, chr(10))) - len(list_distinct(string_split(text, chr(10)))) > 3 THEN 'repeated' WHEN len(regexp_extract_all(text, '[#*$%&|<>]')) * 20 > n_chars THEN 'symbols' ELSE 'ok' END AS verdict FROM documents""",
)
def document_rules(spark, d):
    lines = F.split("text", "\n")
    repeated = F.size(lines) - F.size(F.array_distinct(lines))
    verdict = F.when(F.col("n_chars") < 100, "short").when(repeated > 3, "repeated").when(F.regexp_count("text", F.lit("[#*$%&|<>]")) * 20 > F.col("n_chars"), "symbols").otherwise("ok")
    return table(spark, d, "documents").select("doc_id", verdict.alias("verdict"))


@query("labelled_quality", """SELECT source, count(*) AS n, count(*) FILTER (quality = 0) AS low, count(*) FILTER (toxic = 1) AS toxic, rank() OVER (ORDER BY count(*) FILTER (quality = 0) DESC, source) AS place FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def labelled_quality(spark, d):
    g = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("low"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("low"), "source")).cast("long"))  # one row for each source
