"""Boxes and cells made of the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import spatial
from tallyframe.plans.registry import query, table

A = "SELECT p_partkey AS id, p_size % 5 AS page, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 91 % 700)::DOUBLE AS y0, (p_partkey * 37 % 500)::DOUBLE + p_size AS x1, (p_partkey * 91 % 700)::DOUBLE + 8 AS y1 FROM part"
B = "SELECT s_suppkey AS id, s_suppkey % 5 AS page, (s_suppkey * 53 % 500)::DOUBLE AS x0, (s_suppkey * 17 % 700)::DOUBLE AS y0, (s_suppkey * 53 % 500)::DOUBLE + 30 AS x1, (s_suppkey * 17 % 700)::DOUBLE + 40 AS y1 FROM supplier"
INK = "SELECT DISTINCT l_suppkey % 5 AS page, l_orderkey * 13 % 500 AS x, l_partkey * 29 % 700 AS y FROM lineitem"


def boxes(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), (F.col("p_size") % 5).alias("page"), (k * 37 % 500).cast("double").alias("x0"), (k * 91 % 700).cast("double").alias("y0"), ((k * 37 % 500) + F.col("p_size")).cast("double").alias("x1"), ((k * 91 % 700) + 8).cast("double").alias("y1"))


def areas(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (k % 5).alias("page"), (k * 53 % 500).cast("double").alias("x0"), (k * 17 % 700).cast("double").alias("y0"), ((k * 53 % 500) + 30).cast("double").alias("x1"), ((k * 17 % 700) + 40).cast("double").alias("y1"))


def ink(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("page"), (F.col("l_orderkey") * 13 % 500).alias("x"), (F.col("l_partkey") * 29 % 700).alias("y")).distinct()


@query("box_overlap", f"SELECT a.page, a.id AS a, b.id AS b FROM ({A}) a JOIN ({B}) b ON a.page = b.page AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def box_overlap(spark, d):
    return spatial.overlapping(boxes(spark, d), areas(spark, d), "page", 64.0)


@query("clear_above", f"SELECT a.id, coalesce(min(a.y0 - i.y), 8.0)::DOUBLE AS clear FROM ({A}) a LEFT JOIN ({INK}) i ON a.page = i.page AND i.x >= a.x0 AND i.x < a.x1 AND i.y < a.y0 AND a.y0 - i.y <= 8 GROUP BY a.id")
def clear_above(spark, d):
    return spatial.clear_above(boxes(spark, d), ink(spark, d), "page", 8.0)


SPOTS = "SELECT s_suppkey % 5 AS page, s_suppkey * 53 % 500 AS x, s_suppkey * 17 % 700 AS y FROM supplier"


@query(
    "nearest_ink",
    f"SELECT a.id, least(coalesce(min(CASE WHEN i.x IS NOT NULL THEN greatest(a.x0 - i.x, i.x - a.x1, a.y0 - i.y, i.y - a.y1, 0) END), 25), 25)::BIGINT AS clear FROM ({A}) a LEFT JOIN ({SPOTS}) i ON a.page = i.page AND i.x BETWEEN a.x0 - 25 AND a.x1 + 25 AND i.y BETWEEN a.y0 - 25 AND a.y1 + 25 GROUP BY a.id",
)
def nearest_ink(spark, d):
    k = F.col("s_suppkey")
    spots = table(spark, d, "supplier").select((k % 5).alias("page"), (k * 53 % 500).alias("x"), (k * 17 % 700).alias("y"))
    return spatial.nearest_ink(boxes(spark, d), spots, "page", 25)


def connected(cells: str, each: str) -> str:
    """SQL of the parts that squares (page, gx, gy) form, by their first square; `each` reads s (squares) and m (roots)."""
    return f"""WITH RECURSIVE s AS ({cells}),
          r AS (SELECT page, gx, gy, gy * 10000 + gx AS root FROM s UNION SELECT s.page, s.gx, s.gy, r.root FROM r JOIN s ON s.page = r.page AND s.gx BETWEEN r.gx - 1 AND r.gx + 1 AND s.gy BETWEEN r.gy - 1 AND r.gy + 1 AND r.root < s.gy * 10000 + s.gx),
          m AS (SELECT page, gx, gy, min(root) AS root FROM r GROUP BY 1, 2, 3) {each}"""


@query(
    "grid_components",
    connected(
        f"SELECT page, x // 2 AS gx, y // 2 AS gy, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM ({INK}) GROUP BY 1, 2, 3",
        "SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum(n)::BIGINT AS n FROM s JOIN m USING (page, gx, gy) GROUP BY page, root HAVING sum(n) >= 2",
    ),
)
def grid_components(spark, d):
    return spatial.regions(ink(spark, d), "page", 2, 2)


@query(
    "pixel_components",
    connected(
        f"SELECT page, x AS gx, y AS gy FROM ({INK})",
        "SELECT page, gx AS x, gy AS y, dense_rank() OVER (PARTITION BY page ORDER BY root)::INT AS label FROM m",
    ),
)
def pixel_components(spark, d):
    return spatial.labelled(ink(spark, d), "page")


RASTER = "SELECT r_regionkey AS page, x, y, (x * x * 7 + y * y * 13 + x * y * 3 + r_regionkey * 31) % 256 AS level FROM region, range(40) a(x), range(40) b(y)"


@query(
    "ink_blobs",
    connected(
        f"SELECT page, x AS gx, y AS gy FROM ({RASTER}) WHERE level < 60",
        f""", l AS (SELECT page, gx AS x, gy AS y, dense_rank() OVER (PARTITION BY page ORDER BY root)::INT AS label FROM m),
          near AS (SELECT DISTINCT page, label, x + i AS x, y + j AS y FROM l, range(-1, 2) a(i), range(-1, 2) b(j)),
          seen AS (SELECT near.*, level, greatest(200 - coalesce(level, 200), 0) AS dark FROM near LEFT JOIN ({RASTER}) USING (page, x, y))
        SELECT page, label, n, round(sum(dark * (x + 0.5)) / sum(dark), 6)::DOUBLE AS cx, round(sum(dark * (y + 0.5)) / sum(dark), 6)::DOUBLE AS cy, bool_or(level IS NULL) AS clipped
        FROM seen JOIN (SELECT page, label, count(*) AS n FROM l GROUP BY ALL) USING (page, label) GROUP BY page, label, n""",
    ),
)
def ink_blobs(spark, d):
    k, along = F.col("r_regionkey"), F.sequence(F.lit(0), F.lit(39))
    at = table(spark, d, "region").select(k.alias("page"), F.explode(along).alias("x")).select("page", "x", F.explode(along).alias("y"))
    x, y = F.col("x"), F.col("y")
    raster = at.withColumn("level", (x * x * 7 + y * y * 13 + x * y * 3 + F.col("page") * 31) % 256)
    return spatial.blobs(raster, "page", 60, 200).select("page", "label", "n", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "clipped")


def merging(n: int) -> str:
    """SQL of one round: boxes b<n> that hang together by overlaps, each under its least id, as one box of b<n + 1>."""
    return f"""r{n} AS (SELECT page, id, id AS root FROM b{n} UNION SELECT y.page, y.id, r.root FROM r{n} r JOIN b{n} x ON x.page = r.page AND x.id = r.id
                     JOIN b{n} y ON y.page = x.page AND x.x0 < y.x1 AND y.x0 < x.x1 AND x.y0 < y.y1 AND y.y0 < x.y1 AND r.root < y.id),
          b{n + 1} AS (SELECT page, root AS id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT page, id, min(root) AS root FROM r{n} GROUP BY 1, 2) JOIN b{n} USING (page, id) GROUP BY page, root)"""


@query(
    "merged_boxes",
    f"WITH RECURSIVE b1 AS (SELECT id, id // 100 AS page, x0, y0, x1 + 20 AS x1, y1 + 12 AS y1 FROM ({A})), " + ", ".join(merging(n) for n in range(1, 8)) + " SELECT page, id, x0, y0, x1, y1 FROM b8",
)
def merged_boxes(spark, d):
    """A hundred boxes to a page; seven rounds are more than any page of these needs."""
    found = boxes(spark, d).select("id", F.floor(F.col("id") / 100).alias("page"), "x0", "y0", (F.col("x1") + 20).alias("x1"), (F.col("y1") + 12).alias("y1"))
    return spatial.merged_boxes(found, "page", 64.0)


@query("without_dust", """SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, max(l_quantity >= 40) OVER (PARTITION BY l_orderkey) AS big FROM lineitem) WHERE big""")
def without_dust(spark, d):
    return spatial.without_dust(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity", 40.0)


@query("row_rectangles", f"SELECT page, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS i FROM ({INK})) GROUP BY page, y, i")
def row_rectangles(spark, d):
    return spatial.row_rectangles(ink(spark, d), "page")


@query(
    "best_owners",
    """WITH s AS (SELECT s_suppkey AS id, s_suppkey // 10 AS row, (s_suppkey * 53 % 500)::DOUBLE AS cx FROM supplier), b AS (SELECT p_partkey AS id, p_partkey // 200 AS row, (p_partkey * 37 % 500)::DOUBLE AS cx FROM part)
       SELECT s.id AS small, b.id AS base FROM s JOIN b ON s.row = b.row AND abs(s.cx - b.cx) <= 20 QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY abs(s.cx - b.cx), b.id) = 1""",
)
def best_owners(spark, d):
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    small = table(spark, d, "supplier").select(k.alias("id"), F.floor(k / 10).alias("row"), (k * 53 % 500).cast("double").alias("cx"))
    base = table(spark, d, "part").select(p.alias("id"), F.floor(p / 200).alias("row"), (p * 37 % 500).cast("double").alias("cx"))
    return spatial.owners(small, base, "row", 20.0)
