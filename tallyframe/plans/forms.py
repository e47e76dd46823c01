"""Places, pages, recipes, stock, bundles, marks and saved documents, over the standard tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import forms
from tallyframe.functions.measure import undo_similarity
from tallyframe.operators import marks
from tallyframe.operators.store import Store, run_job
from tallyframe.operators.tables import shared_folder, written
from tallyframe.plans.registry import query, table


@query(
    "anchor_places",
    """SELECT p_partkey, CASE WHEN w IN ('after', 'below', 'below-end') THEN w WHEN w = 'belowend' THEN 'below-end' END AS place
       FROM (SELECT p_partkey, lower(trim(CASE p_partkey % 5 WHEN 0 THEN ' After' WHEN 1 THEN 'BELOW ' WHEN 2 THEN 'below-End' WHEN 3 THEN 'belowEnd' ELSE p_name END)) AS w FROM part)""",
)
def anchor_places(spark, d):
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, " After").when(k == 1, "BELOW ").when(k == 2, "below-End").when(k == 3, "belowEnd").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", forms.anchor_place(said).alias("place"))


COVERED = ["z", "é", " ", "ɐ", "Ω", "─", "Ж", "a", "Ａ", "ᴀ", "☃", "ß", " ", "\t", "9", "\U0001d400", "", "z"]
COMMON = ["a", "b", "Z", "9", "-"]


@query(
    "alphabets",
    """SELECT p_partkey, array_to_string(list_filter(['a', 'b', 'Z', '9', '-'], lambda c: contains(p_name || 'zéΩЖaß9', c)) || list_filter(x, lambda c: NOT list_contains(['a', 'b', 'Z', '9', '-'], c)), '') AS characters
       FROM (SELECT p_partkey, p_name, list_filter(k, lambda c, i: list_position(k, c) = i) AS x FROM (SELECT p_partkey, p_name, string_split('zéΩЖaß9' || replace(p_name, ' ', ''), '') AS k FROM part))""",
)
def alphabets(spark, d):
    covered = F.concat(F.array(*[F.lit(c) for c in COVERED]), F.split("p_name", ""))
    return table(spark, d, "part").select("p_partkey", F.array_join(forms.alphabet(F.array(*[F.lit(c) for c in COMMON]), F.filter(covered, lambda c: c != "")), "").alias("characters"))


@query(
    "paper_points",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 250 + 0.5) AS x, (l_orderkey % 320 + 0.5) AS y FROM lineitem),
            m AS (SELECT *, (x - 105 - 2) / 1.01 AS ux, (y - 148.5 + 3) / 1.01 AS uy, radians(1.5) AS a FROM p)
       SELECT count(*) FILTER (ux * cos(a) + uy * sin(a) + 105 BETWEEN 5 AND 205 AND uy * cos(a) - ux * sin(a) + 148.5 BETWEEN 5 AND 292) AS paper, count(*) AS points FROM m""",
)
def paper_points(spark, d):
    fit = {k: F.lit(v) for k, v in {"rotation": 1.5, "scale": 1.01, "dx": 2.0, "dy": -3.0}.items()}
    x, y = undo_similarity(F.col("l_partkey") % 250 + 0.5, F.col("l_orderkey") % 320 + 0.5, fit, (105.0, 148.5))
    return table(spark, d, "lineitem").agg(F.count_if(forms.on_paper(x, y, F.lit(210.0), F.lit(297.0), 5.0)).alias("paper"), F.count("*").alias("points"))


@query(
    "marks_of_points",
    """WITH p AS (SELECT DISTINCT l_suppkey % 5 AS page, l_orderkey % 40 AS label, (l_partkey % 90) / 4.0::DOUBLE AS x, (l_linenumber * 3 + l_orderkey % 7) / 4.0::DOUBLE AS y FROM lineitem)
       SELECT page, label, min(x) - 0.125 AS x, min(y) - 0.125 AS y, max(x) - min(x) + 0.25 AS w, max(y) - min(y) + 0.25 AS h, count(*) / 16.0::DOUBLE AS ink FROM p GROUP BY page, label""",
)
def marks_of_points(spark, d):
    points = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("page"), (F.col("l_orderkey") % 40).alias("label"), (F.col("l_partkey") % 90 / 4.0).alias("px"), ((F.col("l_linenumber") * 3 + F.col("l_orderkey") % 7) / 4.0).alias("py")).distinct()
    return marks.marks(points, ["page", "label"], F.col("px"), F.col("py"), 4.0)


@query(
    "shapes_of_characters",
    """WITH o AS (SELECT substr(p_name, 1, 1) AS ch, p_brand AS face, (p_partkey % 600)::DOUBLE AS x, (p_size * 20 - 200)::DOUBLE AS y FROM part)
       SELECT face, ch, round((max(y) - min(y)) / 1000 / 0.7, 6) AS height, round((max(x) - min(x)) / (max(y) - min(y)), 6) AS aspect, round(min(y) / 1000, 6) AS sits FROM o GROUP BY face, ch HAVING max(y) > min(y)""",
)
def shapes_of_characters(spark, d):
    outlines = table(spark, d, "part").select(F.substring("p_name", 1, 1).alias("ch"), F.col("p_brand").alias("face"), (F.col("p_partkey") % 600).cast("double").alias("x"), (F.col("p_size") * 20 - 200).cast("double").alias("y"))
    got = marks.shapes_of(outlines, ["face", "ch"], "x", "y", 1000.0, 0.7)
    return got.select("face", "ch", *[F.round(c, 6).alias(c) for c in ("height", "aspect", "sits")])


@query("described_columns", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{' || p_name || '}, {size}' ELSE '{size}' END AS said FROM part""")
def described_columns(spark, d):
    names = F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), F.lit("size"), F.lit(""))
    return table(spark, d, "part").select("p_partkey", forms.described(names).alias("said"))


@query(
    "ledger_tally",
    """WITH l AS (SELECT o_custkey AS path, arg_max(o_orderstatus, o_orderkey) AS s, max(o_orderkey) AS last FROM orders GROUP BY 1)
       SELECT path, last, CASE WHEN s = 'F' THEN 'failed' ELSE 'worked' END AS verdict, row_number() OVER (ORDER BY last) AS number FROM l""",
)
def ledger_tally(spark, d):
    """What was done to each file last, oldest first."""
    from tallyframe.operators.sequence import numbered

    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"), F.max("o_orderkey").alias("last"))
    return numbered(last, "last").select("path", "last", F.when(F.col("s") == "F", "failed").otherwise("worked").alias("verdict"), "number")


@query(
    "page_lines",
    """WITH i AS (SELECT l_linenumber::BIGINT AS page, l_comment FROM (SELECT l_linenumber, l_returnflag || l_partkey AS l_comment, l_returnflag FROM lineitem) WHERE l_returnflag <> 'N')
       SELECT p.page, count(i.page) AS lines, max(l_comment) AS last FROM range(1, 8) p(page) LEFT JOIN i USING (page) GROUP BY p.page""",
)
def page_lines(spark, d):
    """What was added since printing (all but N), by page of a document of seven."""
    items = table(spark, d, "lineitem").filter("l_returnflag <> 'N'").select(F.col("l_linenumber").cast("long").alias("page"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("line"))
    return marks.by_page(items, "page", "line", 7)


@query(
    "recipes",
    """SELECT o_orderkey, a = 0 AND b = 0 AS asks_nothing, b > 0 AS needs_reading FROM (SELECT o_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""",
)
def recipes(spark, d):
    """Placements and anchors of each order's lines: whether it asks for anything, and whether pages have to be read for it."""
    lists = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.collect_list(F.when(F.col("l_returnflag") == f, F.col("l_linenumber"))).alias(c) for f, c in (("A", "at"), ("R", "after"))])
    return lists.select("o_orderkey", forms.asks_nothing(F.col("at"), F.col("after"), F.lit(None).cast("array<int>")).alias("asks_nothing"), (~forms.asks_nothing(F.col("after"))).alias("needs_reading"))


@query(
    "stock_sheets",
    """WITH s AS (SELECT p_partkey, p_size % 4 + 1 AS across, p_size % 7 AS down, CASE WHEN p_partkey % 2 = 0 THEN 'L' || p_partkey ELSE 'Stock-' || (p_partkey + 1000) END AS code, p_name, p_brand FROM part)
       SELECT p_partkey, (across * down)::BIGINT AS per_sheet, (across * 60.5 + (across - 1) * 2.5)::DOUBLE AS across_mm, (down * 30.25 + greatest(down - 1, 0) * 1.5)::DOUBLE AS down_mm, rpad(code, greatest(8, length(code))::INT, ' ') || ' ' || p_brand || ' — ' || p_name AS said FROM s""",
)
def stock_sheets(spark, d):
    k, across, down = F.col("p_partkey"), F.col("p_size") % 4 + 1, F.col("p_size") % 7
    code = F.when(k % 2 == 0, F.concat(F.lit("L"), k)).otherwise(F.concat(F.lit("Stock-"), k + 1000))
    return table(spark, d, "part").select(k, (across * down).cast("long").alias("per_sheet"), forms.taken_up(across, F.lit(60.5), F.lit(2.5)).alias("across_mm"), forms.taken_up(down, F.lit(30.25), F.lit(1.5)).alias("down_mm"), forms.listed(code, F.col("p_brand"), F.col("p_name")).alias("said"))


@query("setups", """SELECT r_regionkey, count(n_nationkey) FILTER (n_nationkey % 2 = 0) AS jobs, count(n_nationkey) FILTER (n_nationkey % 7 = 1) AS profiles, count(n_nationkey) FILTER (n_nationkey % 2 = 0 OR n_nationkey % 7 = 1) = 0 AS is_empty FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND r_regionkey <> 3 GROUP BY 1""")
def setups(spark, d):
    """A bundle of each region's jobs and profiles, and whether it carries anything; one region has none."""
    n = table(spark, d, "nation").filter("n_regionkey <> 3")
    kinds = reduce(DataFrame.unionAll, [n.filter(F.col("n_nationkey") % m == r).select(F.col("n_regionkey").alias("r_regionkey"), F.lit(kind).alias("kind"), "n_name") for kind, m, r in (("jobs", 2, 0), ("profiles", 7, 1))])
    bundle = kinds.groupBy("r_regionkey").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("n_name"))).alias(k) for k in ("jobs", "profiles")])
    out = table(spark, d, "region").select("r_regionkey").join(bundle, "r_regionkey", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    return out.select("r_regionkey", size("jobs"), size("profiles"), forms.asks_nothing(F.col("jobs"), F.col("profiles")).alias("is_empty"))


@query(
    "picture_memory",
    """WITH s AS (SELECT l_suppkey, 100 + l_suppkey % 500 AS dpi, sum(greatest(round((l_quantity + 100) * (100 + l_suppkey % 500) / 25.4::DOUBLE), 1) * greatest(round(297 * (100 + l_suppkey % 500) / 25.4::DOUBLE), 1) * 3) AS bytes FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)
       SELECT l_suppkey, bytes, CASE WHEN bytes > 1610612736 THEN greatest(floor(dpi * sqrt(1610612736 / bytes) / 10) * 10, 50)::BIGINT END AS suggestion FROM s""",
)
def picture_memory(spark, d):
    dpi = 100 + F.col("l_suppkey") % 500
    size = lambda mm: F.greatest(F.round(mm * dpi / 25.4), F.lit(1.0))
    pages = table(spark, d, "lineitem").filter("l_linenumber = 1").groupBy("l_suppkey").agg(F.sum(size(F.col("l_quantity") + 100) * size(F.lit(297)) * 3).alias("bytes"))
    return pages.select("l_suppkey", "bytes", forms.suggested_dpi(F.col("bytes"), dpi).cast("long").alias("suggestion"))


SCATTERED = """SELECT p_partkey AS id, p_size % 5 AS page, (p_partkey * 37 % 500)::DOUBLE AS x, (p_partkey * 91 % 300)::DOUBLE AS y, 2 + (p_partkey * 7 % 13)::DOUBLE AS w, 1 + (p_partkey * 11 % 29)::DOUBLE * (p_partkey * 5 % 7)::DOUBLE / 4 AS h FROM part"""


@query(
    "owned_marks",
    f"""WITH RECURSIVE m AS ({SCATTERED}),
            p AS (SELECT m.page, m.id, b.id AS base, abs(b.x + b.w / 2 - m.x - m.w / 2) AS apart, b.h FROM m JOIN m b ON m.page = b.page AND m.id <> b.id AND m.h <= b.h * 0.55
                  AND (CASE WHEN least(b.w + 2 * (b.h * 0.3), m.w) > 0 THEN greatest(least(b.x + b.w + b.h * 0.3, m.x + m.w) - greatest(b.x - b.h * 0.3, m.x), 0) / least(b.x + b.w + b.h * 0.3 - (b.x - b.h * 0.3), m.x + m.w - m.x) ELSE 0 END) >= 0.5
                  AND CASE WHEN m.y + m.h <= b.y + b.h * 0.25 THEN b.y - (m.y + m.h) < b.h * 0.5 WHEN m.y >= b.y + b.h - b.h * 0.05 THEN m.y - (b.y + b.h) < b.h * 0.3 ELSE false END),
            c AS (SELECT page, id, base FROM p QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY apart, h DESC, base) = 1),
            depth AS (SELECT page, id, 0 AS d FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page = m.page AND c.id = m.id)
                      UNION ALL SELECT c.page, c.id, d + 1 FROM depth JOIN c ON c.page = depth.page AND c.base = depth.id)
       SELECT depth.page, depth.id, CASE WHEN d % 2 = 1 THEN base END AS owner FROM depth LEFT JOIN c ON c.page = depth.page AND c.id = depth.id""",
)
def owned_marks(spark, d):
    k = F.col("p_partkey")
    num = lambda c: c.cast("double")
    found = table(spark, d, "part").select(k.alias("id"), (F.col("p_size") % 5).alias("page"), num(k * 37 % 500).alias("x"), num(k * 91 % 300).alias("y"), (2 + num(k * 7 % 13)).alias("w"), (1 + num(k * 11 % 29) * num(k * 5 % 7) / 4).alias("h"))
    return marks.owned(found, "page", 32.0)


@query(
    "saved_jobs",
    """SELECT 'by-balance' AS job, n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 1000 GROUP BY 2
       UNION ALL SELECT 'by-balance-7000', n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 7000 GROUP BY 2
       UNION ALL SELECT 'suppliers', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY 2""",
)
def saved_jobs(spark, d):
    """Jobs are saved, one is saved anew and one deleted; those that are left are read and run, one with another value."""
    store = Store(spark, f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}")
    by_balance = "SELECT n_name AS name, count(*) AS n FROM {customer} c JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal > :least GROUP BY n_name"
    suppliers = "SELECT n_name AS name, count(*) AS n FROM {supplier} s JOIN {nation} ON s_nationkey = n_nationkey WHERE n_regionkey = :region GROUP BY n_name"
    job = lambda statement, **given: F.to_json(F.struct(F.lit(statement).alias("statement"), F.struct(*[F.lit(v).alias(k) for k, v in given.items()]).alias("parameters")), {"ignoreNullFields": "false"})
    one = spark.range(1)
    store.save(one.select(F.lit("by-balance").alias("name"), job("SELECT 1", least=5).alias("document")).unionAll(one.select(F.lit("gone"), job("SELECT 2", x=1))))
    store.save(one.select(F.lit("by-balance").alias("name"), job(by_balance, least=1000).alias("document")).unionAll(one.select(F.lit("suppliers"), job(suppliers, region=None))))
    store.delete("gone")
    names = [r["name"] for r in store.all().orderBy("name").collect()]  # the jobs of this store: two
    tables = {t: table(spark, d, t) for t in ("customer", "nation", "supplier")}
    runs = [(name, name, {"region": 2} if name == "suppliers" else {}) for name in names] + [("by-balance-7000", "by-balance", {"least": 7000})]
    done = []
    for shown, name, given in runs:
        saved = store.load(name)
        used = {t: v for t, v in tables.items() if f"{{{t}}}" in saved["statement"]}
        done.append(run_job(spark, saved, used, **given).select(F.lit(shown).alias("job"), "name", "n"))
    return reduce(DataFrame.unionAll, done)


@query(
    "saved_profiles",
    """SELECT 'p-' || n_nationkey AS name, CASE WHEN n_regionkey = 1 THEN n_nationkey * 2.5 ELSE n_nationkey * 1.5 END::DOUBLE AS scale FROM nation WHERE n_nationkey <> 7 AND n_nationkey % 5 <> 4""",
)
def saved_profiles(spark, d):
    """A profile for each nation; a region's are saved anew, one is deleted, and some are damaged and stop no others."""
    store = Store(spark, f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}")
    n = table(spark, d, "nation")
    name, k = F.concat(F.lit("p-"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey")
    whole = lambda by: F.when(k % 5 == 4, "damaged {").otherwise(F.to_json(F.struct((k * by).alias("scale"))))
    store.save(n.select(name, whole(1.5).alias("document")))
    store.save(n.filter("n_regionkey = 1").select(name, whole(2.5).alias("document")))
    store.delete("p-7")
    return written(store.all().select("name", F.get_json_object("document", "$.scale").cast("double").alias("scale")), "profiles")
