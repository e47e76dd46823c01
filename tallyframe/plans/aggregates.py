"""Aggregations, fits, windows and orders over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import fits, islands, rank, scan
from tallyframe.plans.registry import query, table


@query("counts_and_gaps", """SELECT event_type, count(*) AS cells, count(*) FILTER (value > 50) AS read, count(*) FILTER (value <= 50) AS gaps FROM events GROUP BY 1""")
def counts_and_gaps(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("cells"), F.count_if(F.col("value") > 50).alias("read"), F.count_if(F.col("value") <= 50).alias("gaps"))


@query("verdict_tally", """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS other FROM events GROUP BY 1""")
def verdict_tally(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(t == "purchase").alias("done"), F.count_if(t == "error").alias("failed"), F.count_if(~t.isin("purchase", "error")).alias("other"))


SHEETS_SQL = """WITH m AS (SELECT l_orderkey AS run, l_suppkey % 4 AS sheet, abs(l_discount - l_tax) * 10 AS miss, l_returnflag FROM lineitem),
  s AS (SELECT run, sheet, count(*) FILTER (l_returnflag = 'N') AS absent, count(*) FILTER (miss > 0.4) AS unmeasurable, count(*) FILTER (miss <= 0.4 AND miss > 0.2) AS adrift, coalesce(max(miss) FILTER (miss <= 0.4), 0) AS worst FROM m GROUP BY 1, 2)"""


def sheets(spark, d):
    miss = F.abs(F.col("l_discount") - F.col("l_tax")) * 10
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_suppkey") % 4).alias("sheet"), miss.alias("miss"), "l_returnflag")
    return m.groupBy("run", "sheet").agg(
        F.count_if(F.col("l_returnflag") == "N").alias("absent"), F.count_if(F.col("miss") > 0.4).alias("unmeasurable"),
        F.count_if((F.col("miss") <= 0.4) & (F.col("miss") > 0.2)).alias("adrift"), F.coalesce(F.max(F.when(F.col("miss") <= 0.4, F.col("miss"))), F.lit(0.0)).alias("worst"),
    )


@query("sheet_report", SHEETS_SQL + " SELECT run, sheet, absent, unmeasurable, adrift, round(worst, 6) AS worst FROM s")
def sheet_report(spark, d):
    return sheets(spark, d).withColumn("worst", F.round("worst", 6))


@query("run_report", SHEETS_SQL + " SELECT run, list_sort(list(sheet) FILTER (adrift > 0)) AS adrift, count(*) FILTER (unmeasurable > 0) AS unreadable, arg_max(sheet, round(worst, 6) * 100 - sheet) AS worst_sheet FROM s GROUP BY run".replace("list_sort(list(sheet) FILTER (adrift > 0))", "coalesce(list_sort(list(sheet) FILTER (adrift > 0)), [])"))
def run_report(spark, d):
    s = sheets(spark, d)
    return s.groupBy("run").agg(F.sort_array(F.collect_list(F.when(F.col("adrift") > 0, F.col("sheet")))).alias("adrift"), F.count_if(F.col("unmeasurable") > 0).alias("unreadable"), F.max_by("sheet", F.round("worst", 6) * 100 - F.col("sheet")).alias("worst_sheet"))


@query("totals", """SELECT l_returnflag, count(*) AS regions, round(sum(l_quantity * l_tax), 4) AS area, count(DISTINCT l_orderkey) AS pages, round(least(sum(l_tax) / nullif(sum(l_discount), 0), 1), 6) AS share FROM lineitem GROUP BY 1""")
def totals(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("regions"), F.round(F.sum(F.col("l_quantity") * F.col("l_tax")), 4).alias("area"), F.count_distinct("l_orderkey").alias("pages"), F.round(F.least(F.try_divide(F.sum("l_tax"), F.sum("l_discount")), F.lit(1.0)), 6).alias("share"))


@query("extents", """SELECT l_suppkey, min(l_quantity) AS x0, max(l_quantity + 5) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1, round(sum(l_quantity), 4) AS ink FROM lineitem GROUP BY 1""")
def extents(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_quantity").alias("x0"), F.max(F.col("l_quantity") + 5).alias("x1"), F.min("l_extendedprice").alias("y0"), F.max("l_extendedprice").alias("y1"), F.round(F.sum("l_quantity"), 4).alias("ink"))


@query(
    "grid_shares",
    """WITH c AS (SELECT l_suppkey % 3 AS page, l_orderkey % 24 AS cx, l_partkey % 34 AS cy, avg((l_tax > 0.04)::INT) AS ink FROM lineitem GROUP BY 1, 2, 3),
            s AS (SELECT p.page, x.i AS cx, y.i AS cy FROM range(3) p(page), range(24) x(i), range(34) y(i))
       SELECT page, cx, cy, round(coalesce(ink, 0), 6) AS ink FROM s LEFT JOIN c USING (page, cx, cy)""",
)
def grid_shares(spark, d):
    cells = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("page"), (F.col("l_orderkey") % 24).alias("cx"), (F.col("l_partkey") % 34).alias("cy")).agg(F.avg((F.col("l_tax") > 0.04).cast("int")).alias("ink"))
    n = F.col("id")
    spine = spark.range(3 * 24 * 34).select(F.floor(n / 816).alias("page"), F.floor(n % 816 / 34).alias("cx"), (n % 34).alias("cy"))
    return spine.join(cells, ["page", "cx", "cy"], "left").select("page", "cx", "cy", F.round(F.coalesce("ink", F.lit(0.0)), 6).alias("ink"))


@query("value_shares", """SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id), 9) AS share FROM events WHERE value > 0""")
def value_shares(spark, d):
    rows = table(spark, d, "events").filter("value > 0").select("event_id", "user_id", "value")
    sums = rows.groupBy(F.col("user_id").alias("whose")).agg(F.sum("value").alias("total"))
    return rows.join(sums, F.col("user_id").eqNullSafe(F.col("whose"))).select("event_id", F.round(F.col("value") / F.col("total"), 9).alias("share"))


@query("indexed_quantiles", """SELECT l_suppkey, len(v) AS n, v[len(v) // 4 + 1] AS lower, v[len(v) // 2 + 1] AS median, v[3 * len(v) // 4 + 1] AS upper FROM (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)""")
def indexed_quantiles(spark, d):
    return fits.indexed_quantiles(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")


@query(
    "trimmed_deviation",
    """WITH v AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY 1), k AS (SELECT l_suppkey, len(v) AS n, v[len(v) // 2 + 1] AS m, v[len(v) // 10 + 1 : len(v) - len(v) // 10] AS kept FROM v)
       SELECT l_suppkey, CASE WHEN n >= 12 THEN round(list_sum(list_transform(kept, lambda x: abs(x - m) / m)) / len(kept), 6) END AS deviation FROM k""",
)
def trimmed_deviation(spark, d):
    return fits.trimmed_deviation(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity").select("l_suppkey", F.round("deviation", 6).alias("deviation"))


@query("fitted_lines", """SELECT l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1""")
def fitted_lines(spark, d):
    return fits.line(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").select("l_suppkey", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query(
    "fit_residuals",
    """WITH f AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY 1)
       SELECT l_suppkey, round(sqrt(avg((l_extendedprice - (s * l_quantity + i)) ** 2)) / avg(l_extendedprice), 6) AS score FROM lineitem JOIN f USING (l_suppkey) GROUP BY 1""",
)
def fit_residuals(spark, d):
    rows = table(spark, d, "lineitem")
    judged = rows.join(fits.line(rows, ["l_suppkey"], "l_quantity", "l_extendedprice").drop("n"), "l_suppkey")
    miss = fits.residual("l_quantity", "l_extendedprice")
    return judged.groupBy("l_suppkey").agg(F.round(F.sqrt(F.avg(miss * miss)) / F.avg("l_extendedprice"), 6).alias("score"))


def robust_round(n: int) -> str:
    """SQL of one refit: the points of k<n> that miss its line by at most four times the upper median miss, as k<n + 1>."""
    return f"""f{n} AS (SELECT a, b, regr_slope(y, x) AS s, regr_intercept(y, x) AS c FROM k{n} GROUP BY a, b), m{n} AS (SELECT k.*, abs(y - (s * x + c)) AS miss FROM k{n} k JOIN f{n} USING (a, b)),
            l{n} AS (SELECT a, b, 4 * v[len(v) // 2 + 1] AS lim FROM (SELECT a, b, list_sort(list(miss)) AS v FROM m{n} GROUP BY a, b)),
            e{n} AS (SELECT m.*, lim, count(*) FILTER (lim = 0 OR miss <= lim) OVER (PARTITION BY m.a, m.b) AS stay FROM m{n} m JOIN l{n} USING (a, b)),
            k{n + 1} AS (SELECT a, b, x, y FROM e{n} WHERE lim = 0 OR miss <= lim OR stay < 3)"""


#: Points with outliers: a third of one group's orders are written in another currency.
CURRENCY = "CASE WHEN l_orderkey % 3 = 0 AND l_returnflag = 'R' THEN l_extendedprice * 40 ELSE l_quantity * 900 + l_extendedprice / 50 END"


@query(
    "robust_lines",
    f"WITH k1 AS (SELECT l_returnflag AS a, l_linestatus AS b, l_quantity AS x, {CURRENCY} AS y FROM lineitem), " + ", ".join(robust_round(n) for n in (1, 2, 3)) + " SELECT a AS l_returnflag, b AS l_linestatus, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM k4 GROUP BY a, b",
)
def robust_lines(spark, d):
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    y = F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_returnflag") == "R"), price * 40).otherwise(q * 900 + price / 50)
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", q.alias("x"), y.alias("y"))
    got = fits.robust_line(rows, ["l_returnflag", "l_linestatus"], "x", "y")
    return got.select("l_returnflag", "l_linestatus", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(
    "edge_angles",
    """WITH p AS (SELECT l_suppkey % 10 AS edge, l_quantity AS x, l_quantity * 0.02 + l_tax * 30 AS y FROM lineitem), f AS (SELECT edge, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p GROUP BY 1 HAVING count(*) >= 16),
            m AS (SELECT p.*, abs(y - (s * x + i)) AS miss, s FROM p JOIN f USING (edge)), l AS (SELECT *, greatest(3 * avg(miss) OVER (PARTITION BY edge), 2.0) AS lim FROM m)
       SELECT edge, round(-degrees(atan(CASE WHEN count(*) FILTER (miss <= lim) >= 16 THEN regr_slope(y, x) FILTER (miss <= lim) ELSE any_value(s) END)), 6) AS degrees FROM l GROUP BY edge""",
)
def edge_angles(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("edge"), F.col("l_quantity").alias("x"), (F.col("l_quantity") * 0.02 + F.col("l_tax") * 30).alias("y"))
    return fits.edge_angle(p, ["edge"], "x", "y").select("edge", F.round("degrees", 6).alias("degrees"))


POINTS = "SELECT s_nationkey AS k, s_suppkey % 200 * 1.0 AS ax, (s_suppkey * 37) % 290 * 1.0 AS ay, (s_suppkey % 200) * 1.02 + ((s_suppkey * 37) % 290) * 0.01 + s_acctbal / 10007 AS bx, ((s_suppkey * 37) % 290) * 1.01 - 2 + s_acctbal / 20011 AS by_ FROM supplier"


def points(spark, d):
    x, y = (F.col("s_suppkey") % 200).cast("double"), ((F.col("s_suppkey") * 37) % 290).cast("double")
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), x.alias("ax"), y.alias("ay"), (x * 1.02 + y * 0.01 + F.col("s_acctbal") / 10007).alias("bx"), (y * 1.01 - 2 + F.col("s_acctbal") / 20011).alias("by_"))


@query(
    "similarity_fit",
    f"""WITH p AS ({POINTS}), g AS (SELECT k, count(*) AS n, (covar_pop(ax, bx) + covar_pop(ay, by_)) / (var_pop(ax) + var_pop(ay)) AS a, (covar_pop(ax, by_) - covar_pop(ay, bx)) / (var_pop(ax) + var_pop(ay)) AS b, avg(ax) AS m0, avg(ay) AS m1, avg(bx) AS m2, avg(by_) AS m3 FROM p GROUP BY k HAVING count(*) >= 2 AND var_pop(ax) + var_pop(ay) >= 1e-12),
              t AS (SELECT *, m2 - 105 - (a * (m0 - 105) - b * (m1 - 148.5)) AS dx, m3 - 148.5 - (b * (m0 - 105) + a * (m1 - 148.5)) AS dy FROM g),
              r AS (SELECT k, sqrt((a * (ax - 105) - b * (ay - 148.5) + 105 + dx - bx) ** 2 + (b * (ax - 105) + a * (ay - 148.5) + 148.5 + dy - by_) ** 2) AS miss FROM p JOIN t USING (k))
        SELECT k, n, round(dx, 6) AS dx, round(dy, 6) AS dy, round(degrees(atan2(b, a)), 6) AS rotation, round(sqrt(a * a + b * b), 6) AS scale, round(rms, 6) AS rms, round(worst, 6) AS worst FROM t JOIN (SELECT k, sqrt(avg(miss ** 2)) AS rms, max(miss) AS worst FROM r GROUP BY k) USING (k)""",
)
def similarity_fit(spark, d):
    got = fits.similarity(points(spark, d), ["k"], (105.0, 148.5), "ax", "ay", "bx", "by_")
    return got.select("k", "n", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "rotation", "scale", "rms", "worst")])


@query(
    "shift_fit",
    f"""WITH p AS ({POINTS}), g AS (SELECT k, count(*) AS n, avg(bx - ax) AS dx, avg(by_ - ay) AS dy FROM p GROUP BY k), r AS (SELECT k, sqrt((bx - ax - dx) ** 2 + (by_ - ay - dy) ** 2) AS miss FROM p JOIN g USING (k))
        SELECT k, n, round(dx, 6) AS dx, round(dy, 6) AS dy, round(sqrt(avg(miss ** 2)), 6) AS rms, round(max(miss), 6) AS worst FROM g JOIN r USING (k) GROUP BY ALL""",
)
def shift_fit(spark, d):
    return fits.shift(points(spark, d), ["k"], "ax", "ay", "bx", "by_").select("k", "n", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "rms", "worst")])


@query(
    "minor_spread",
    f"""WITH p AS ({POINTS}), g AS (SELECT k, 0.5 * atan2(2 * covar_pop(ax, ay), var_pop(ax) - var_pop(ay)) AS t FROM p GROUP BY k)
        SELECT k, round(max(-ax * sin(t) + ay * cos(t)) - min(-ax * sin(t) + ay * cos(t)), 6) AS spread FROM p JOIN g USING (k) GROUP BY k""",
)
def minor_spread(spark, d):
    return fits.minor_spread(points(spark, d), ["k"], "ax", "ay").select("k", F.round("spread", 6).alias("spread"))


@query(
    "learned_profiles",
    f"""WITH p AS ({POINTS}), g AS (SELECT k, 0.5 * atan2(2 * covar_pop(ax, ay), var_pop(ax) - var_pop(ay)) AS t, count(*) AS n FROM p GROUP BY k),
              s AS (SELECT k, n, max(-ax * sin(t) + ay * cos(t)) - min(-ax * sin(t) + ay * cos(t)) AS spread FROM p JOIN g USING (k) GROUP BY k, n)
        SELECT k, n, CASE WHEN spread < 25 THEN 'shift' ELSE 'similarity' END AS kind FROM s WHERE n >= 3""",
)
def learned_profiles(spark, d):
    p = points(spark, d)
    spread = fits.minor_spread(p, ["k"], "ax", "ay").join(p.groupBy("k").agg(F.count("*").alias("n")), "k")
    return spread.filter("n >= 3").select("k", "n", F.when(F.col("spread") < 25, "shift").otherwise("similarity").alias("kind"))


@query("weighted_centres", """SELECT l_suppkey, round(sum(l_tax * l_quantity) / nullif(sum(l_tax), 0), 6) AS x, round(sum(l_tax * l_extendedprice) / nullif(sum(l_tax), 0), 4) AS y FROM lineitem GROUP BY 1""")
def weighted_centres(spark, d):
    at = lambda c: F.try_divide(F.sum(F.col("l_tax") * F.col(c)), F.sum("l_tax"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(at("l_quantity"), 6).alias("x"), F.round(at("l_extendedprice"), 4).alias("y"))


HISTOGRAM = "WITH h AS (SELECT s.level, coalesce(n, 0) AS n FROM range(256) s(level) LEFT JOIN (SELECT floor(l_quantity * l_tax * 50)::INT % 256 AS level, count(*) AS n FROM lineitem GROUP BY 1) c USING (level))"


def levels(spark, d):
    return fits.histogram(table(spark, d, "lineitem"), F.floor(F.col("l_quantity") * F.col("l_tax") * 50) % 256, 256)


@query("histogram", HISTOGRAM + " SELECT level::INT AS level, n FROM h")
def histogram(spark, d):
    return levels(spark, d)


@query(
    "otsu",
    HISTOGRAM + """, c AS (SELECT level, sum(n) OVER w AS w0, sum(level * n) OVER w AS s0, sum(n) OVER () AS a, sum(level * n) OVER () AS t FROM h WINDOW w AS (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
       b AS (SELECT level, CASE WHEN w0 > 0 AND a > w0 THEN w0::DOUBLE * (a - w0) * (s0 / w0 - (t - s0) / (a - w0)) ** 2 END AS v FROM c)
       SELECT coalesce((min(level) + max(level)) // 2, 128)::INT AS threshold FROM b WHERE v >= (SELECT max(v) FROM b) * (1 - 1e-12)""",
)
def otsu(spark, d):
    return fits.otsu(levels(spark, d))


@query("histogram_share", HISTOGRAM + " SELECT min(level)::INT AS level FROM (SELECT level, sum(n) OVER (ORDER BY level) AS c, sum(n) OVER () AS a FROM h) WHERE c * 10 >= a * 9")
def histogram_share(spark, d):
    return fits.histogram_share(levels(spark, d), 9, 10)


@query("weighted_votes", """SELECT user_id, arg_max(event_type, v * 10 + o) AS winner FROM (SELECT user_id, event_type, round(sum(value), 4) AS v, ascii(event_type) / 1000.0 AS o FROM events WHERE event_type <> 'error' GROUP BY 1, 2) GROUP BY 1""")
def weighted_votes(spark, d):
    votes = table(spark, d, "events").filter("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    return votes.groupBy("user_id").agg(F.max_by("event_type", F.struct("v", F.ascii("event_type"))).alias("winner"))


@query(
    "densest_values",
    """WITH w AS (SELECT l_suppkey, l_quantity, count(*) OVER w AS held, avg(l_quantity) OVER w AS mean FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING))
       SELECT l_suppkey, round(arg_max(mean, held * 1000 - l_quantity), 6) AS mode, max(held) AS held FROM w GROUP BY 1""",
)
def densest_values(spark, d):
    return fits.densest(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 2.0).select("l_suppkey", F.round("mode", 6).alias("mode"), "held")


@query("newest_versions", """SELECT p_brand, arg_max(p_size % 3 || '.' || p_size, (p_size % 3) * 1000 + p_size) AS version FROM part GROUP BY 1""")
def newest_versions(spark, d):
    v = table(spark, d, "part").select("p_brand", F.concat((F.col("p_size") % 3).cast("string"), F.lit("."), F.col("p_size").cast("string")).alias("version"))
    part = lambda i: F.split_part("version", F.lit("."), F.lit(i)).cast("int")
    return v.groupBy("p_brand").agg(F.max_by("version", F.struct(part(1), part(2))).alias("version"))


@query("ordered_distinct", """SELECT user_id, list(event_type ORDER BY f) AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1""")
def ordered_distinct(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "event_type"))), lambda s: s["event_type"]).alias("types"))


@query("grid_widths", """SELECT l_suppkey, max(spans)::BIGINT AS columns FROM (SELECT l_suppkey, l_orderkey, sum(1 + l_linenumber % 3) AS spans FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def grid_widths(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum(1 + F.col("l_linenumber") % 3).alias("spans")).groupBy("l_suppkey").agg(F.max("spans").alias("columns"))


@query("clearance_verdicts", """SELECT l_orderkey, bool_and(l_tax < 0.08) AS belongs, bool_or(l_discount > 0.09) AS collides, min(l_quantity) FILTER (l_discount <= 0.09) AS tightest FROM lineitem GROUP BY 1""")
def clearance_verdicts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_tax") < 0.08).alias("belongs"), F.bool_or(F.col("l_discount") > 0.09).alias("collides"), F.min(F.when(F.col("l_discount") <= 0.09, F.col("l_quantity"))).alias("tightest"))


@query("word_counts", """SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, len(regexp_extract_all(text, '[A-Za-z]')) AS letters FROM documents""")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.regexp_count("text", F.lit("[A-Za-z]")).cast("long").alias("letters"))


# --- windows ---------------------------------------------------------------------------------------------------------


@query(
    "compact_runs",
    """WITH r AS (SELECT l_suppkey, min(n) AS a, max(n) AS b FROM (SELECT *, n - row_number() OVER (PARTITION BY l_suppkey ORDER BY n) AS i FROM (SELECT DISTINCT l_suppkey, l_partkey % 60 AS n FROM lineitem)) GROUP BY l_suppkey, i),
            c AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS k FROM r),
            s AS (SELECT l_suppkey, flatten(list(CASE WHEN a = b THEN [a::VARCHAR] WHEN b - a >= 2 THEN [a || ' to ' || b] WHEN k = 1 THEN [a || ' and ' || b] ELSE [a::VARCHAR, b::VARCHAR] END ORDER BY a)) AS p FROM c GROUP BY 1)
       SELECT l_suppkey, CASE WHEN len(p) = 1 THEN p[1] ELSE array_to_string(p[:len(p) - 1], ', ') || ' and ' || p[len(p)] END AS said FROM s""",
)
def compact_runs(spark, d):
    return islands.compacted(table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 60).alias("n")), ["l_suppkey"], "n")


@query(
    "bands",
    """WITH c AS (SELECT user_id, event_id, value > 50 AS high, coalesce((value > 50) <> lag(value > 50) OVER w, true)::INT AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
            b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS band FROM c)
       SELECT user_id, any_value(high) AS high, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM b GROUP BY user_id, band""",
)
def bands(spark, d):
    return islands.bands(table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 50).alias("high")), ["user_id"], "event_id", "high")


@query(
    "longest_run",
    """WITH c AS (SELECT user_id, event_id, value > 50 AS high, event_id - event_id + row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY event_id) AS g FROM events)
       SELECT user_id, coalesce(max(n) FILTER (high), 0) AS longest FROM (SELECT user_id, high, g, count(*) AS n FROM c GROUP BY ALL) GROUP BY 1""",
)
def longest_run(spark, d):
    return islands.longest_run(table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 50).alias("high")), ["user_id"], "event_id", "high")


INTERVALS = "SELECT user_id, event_id, (event_id * 7919 % 5000)::DOUBLE AS l, (event_id * 7919 % 5000) + value / 10 AS r, value AS h FROM events"


def intervals(spark, d):
    at = (F.col("event_id") * 7919 % 5000).cast("double")
    return table(spark, d, "events").select("user_id", "event_id", at.alias("l"), (at + F.col("value") / 10).alias("r"), F.col("value").alias("h"))


@query(
    "wide_gaps",
    f"""SELECT user_id, round(f, 6) AS "from", l AS "to" FROM (SELECT user_id, l, max(r) OVER (PARTITION BY user_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM ({INTERVALS})) WHERE l - f >= 100""",
)
def wide_gaps(spark, d):
    return islands.wide_gaps(intervals(spark, d), ["user_id"], "l", "r", 100.0).withColumn("from", F.round("from", 6))


@query(
    "gap_sessions",
    f"""WITH i AS ({INTERVALS}), m AS (SELECT *, l - max(r) OVER (PARTITION BY user_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM i),
             g AS (SELECT user_id, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gs, list_sort(list(h)) AS hs FROM m GROUP BY 1),
             t AS (SELECT user_id, CASE WHEN coalesce(len(gs), 0) < 4 THEN 0.3 ELSE greatest(2.2 * gs[len(gs) // 2 + 1], 0.45 * hs[len(hs) // 4 + 1], 0.3) END AS lim FROM g)
        SELECT event_id, sum(CASE WHEN gap IS NULL OR gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY l, r)::BIGINT AS session FROM m JOIN t USING (user_id)""",
)
def gap_sessions(spark, d):
    return islands.own_sessions(intervals(spark, d), ["user_id"], "l", "r", "h").select("event_id", "session")


@query(
    "hierarchical_numbers",
    """WITH t AS (SELECT conv_id, turn, 1 + (conv_id + turn * turn) % 3 AS lv FROM conversations),
            a AS (SELECT *, sum((lv < 1)::INT) OVER w AS a1, sum((lv < 2)::INT) OVER w AS a2, sum((lv < 3)::INT) OVER w AS a3 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
            n AS (SELECT *, sum((lv = 1)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n1, sum((lv = 2)::INT) OVER (PARTITION BY conv_id, a2 ORDER BY turn) AS n2, sum((lv = 3)::INT) OVER (PARTITION BY conv_id, a3 ORDER BY turn) AS n3 FROM a)
       SELECT conv_id, turn, array_to_string([n1::VARCHAR, n2::VARCHAR, n3::VARCHAR][1:lv], '.') AS numbers FROM n""",
)
def hierarchical_numbers(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", (1 + (F.col("conv_id") + F.col("turn") * F.col("turn")) % 3).alias("lv"))
    return islands.hierarchical_numbers(t, "conv_id", "turn", "lv", 3).select("conv_id", "turn", "numbers")


@query(
    "adjacent_inversions",
    """SELECT user_id, min(event_id) FILTER (v > nx) AS "at" FROM (SELECT user_id, event_id, event_id * 31 % 1000 AS v, lead(event_id * 31 % 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events) GROUP BY 1 HAVING min(event_id) FILTER (v > nx) IS NOT NULL""",
)
def adjacent_inversions(spark, d):
    stem = F.concat(F.lit("scan 7 page "), F.col("event_id") * 31 % 1000, F.lit(".pdf"))
    return islands.inversions(table(spark, d, "events"), ["user_id"], "event_id", F.regexp_extract(stem, "([0-9]+)[^0-9]*$", 1).cast("long"))


@query("running_offsets", """SELECT user_id, event_id, (1 + coalesce(sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS starts FROM events""")
def running_offsets(spark, d):
    parts = table(spark, d, "events").withColumn("pages", F.col("event_id") % 7)
    return islands.offsets(parts, ["user_id"], "event_id", "pages").select("user_id", "event_id", "starts")


@query("neighbour_gaps", """SELECT event_id, round(g, 6) AS gap FROM (SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY value, event_id) - value AS g FROM events) WHERE g > 0.05 AND g < 40""")
def neighbour_gaps(spark, d):
    gaps = islands.neighbour_gaps(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id")
    return gaps.filter("gap > 0.05 AND gap < 40").select("event_id", F.round("gap", 6).alias("gap"))


@query("last_entries", """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def last_entries(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("most_recent", """SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500""")
def most_recent(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type")  # the newest 500 are the result


# --- ranks and orders ------------------------------------------------------------------------------------------------

VECTORS = "SELECT vec_id AS id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS v FROM embeddings"


def ranked(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("v"))
    return rank.ranked_candidates(v, v, 3)


RANKED = f"""WITH e AS (SELECT id, list_transform(v, lambda x: x / list_sum(v)) AS v FROM ({VECTORS})),
  p AS (SELECT a.id AS sheet, b.id AS candidate, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) / 2 AS d FROM e a, e b),
  r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY d, candidate) AS rank FROM p)"""


@query("rank_candidates", RANKED + " SELECT sheet, candidate, round(d, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 3")
def rank_candidates(spark, d):
    return ranked(spark, d).select("sheet", "candidate", F.round("distance", 6).alias("distance"), "rank")


@query(
    "confident_matches",
    RANKED + " SELECT sheet, any_value(candidate) FILTER (rank = 1) AS candidate, round(min(d) FILTER (rank = 1), 6) AS best, round(min(d) FILTER (rank = 2), 6) AS second, min(d) FILTER (rank = 1) <= 0.3 AND coalesce(min(d) FILTER (rank = 2) - min(d) FILTER (rank = 1) >= 0.12, true) AS sure FROM r GROUP BY sheet",
)
def confident_matches(spark, d):
    got = rank.confident(ranked(spark, d), "sheet", "distance")
    return got.select("sheet", "candidate", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"), "sure")


@query("shortlists", """SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS rank FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 24) QUALIFY rank <= 3""")
def shortlists(spark, d):
    coarse = rank.top(table(spark, d, "part"), ["p_brand"], [F.desc("p_size"), F.col("p_partkey")], 24).drop("rank")
    return rank.top(coarse, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "rank")


@query(
    "near_ties",
    """WITH RECURSIVE l AS (SELECT p_brand, p_retailprice AS score, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
            r AS (SELECT p_brand, i, score, name FROM l WHERE i = 1
                  UNION ALL SELECT l.p_brand, l.i, CASE WHEN l.score > r.score * 1.02::DOUBLE THEN l.score ELSE r.score END, CASE WHEN l.score > r.score * 1.02::DOUBLE THEN l.name ELSE r.name END FROM r JOIN l ON l.p_brand = r.p_brand AND l.i = r.i + 1)
       SELECT p_brand, arg_max(name, i) AS name FROM r GROUP BY 1""",
)
def near_ties(spark, d):
    got = rank.near_ties(table(spark, d, "part"), ["p_brand"], "p_partkey", "p_retailprice", "p_name")
    return got.select("p_brand", F.col("p_name").alias("name"))


@query("reading_order", """SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice / 100 * 10), p_size, p_partkey) AS place FROM part""")
def reading_order(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.round(F.col("p_retailprice") / 100 * 10).alias("row"), "p_size", "p_partkey")
    return scan.placed(rows, ["p_brand"], ["row", "p_size", "p_partkey"]).select("p_partkey", "place")


HEBREW = ("abcdefghijklmnopqrstuvwxyz", "אבגדהוזחטיכלמנסעפצקרשתאבגד")


@query("bidi_order", f"""WITH l AS (SELECT p_partkey, p_type || ' ' || CASE WHEN p_size % 2 = 0 THEN translate(p_name, '{HEBREW[0]}', '{HEBREW[1]}') ELSE p_name END AS line FROM part),
  n AS (SELECT *, list_transform(string_split(line, ''), lambda x: unicode(x)) AS codes FROM l),
  d AS (SELECT *, len(list_filter(codes, lambda c: c BETWEEN 1424 AND 2303)) AS leftward, len(list_filter(codes, lambda c: c BETWEEN 65 AND 90 OR c BETWEEN 97 AND 122)) AS letters FROM n)
  SELECT p_partkey, CASE WHEN leftward > letters THEN reverse(line) ELSE line END AS shown FROM d""")
def bidi_order(spark, d):
    """Lines of which some letters are Hebrew: these read from right to left where they are more than the others."""
    name = F.when(F.col("p_size") % 2 == 0, F.translate("p_name", *HEBREW)).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.as_read(F.concat("p_type", F.lit(" "), name)).alias("shown"))


@query("triple_order", """SELECT p_partkey, rank() OVER (ORDER BY p_brand, p_size::VARCHAR, p_name, p_partkey) AS place FROM part""")
def triple_order(spark, d):
    from tallyframe.operators.sequence import numbered

    keyed = table(spark, d, "part").select("p_brand", F.col("p_size").cast("string").alias("s"), "p_name", "p_partkey")
    return numbered(keyed, "p_brand", "s", "p_name", "p_partkey").select("p_partkey", F.col("number").alias("place"))
