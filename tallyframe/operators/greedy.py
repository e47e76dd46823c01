"""Groupings in which each row is put by what was put before.

A page is cut at gaps that no mark can bridge; what lies between two of them is gathered into one row and walked through in
order, as what follows there depends on all before. So a page may be long, if it isn't dense throughout.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.tables import written


def banded(marks: DataFrame, page: str, low: Column, high: Column, reach: float) -> DataFrame:
    """Add `__band`: a new one begins where a mark lies over `reach` beyond all before it."""
    above = Window.partitionBy(page).orderBy(low, high)
    starts = F.coalesce((low - F.max(high).over(above.rowsBetween(Window.unboundedPreceding, -1)) > reach).cast("int"), F.lit(1))
    return marks.withColumn("__starts", starts).withColumn("__band", F.sum("__starts").over(above.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def lines_by_overlap(marks: DataFrame, page: str, order: str, top: str, bottom: str, least: float = 0.35) -> DataFrame:
    """(page, order, line): marks in order, each in the last line in which it shares over `least` of the smaller height
    with any member, else in a new one; lines are numbered as they begin."""
    mark = F.struct(F.col(order).alias("o"), F.col(top).cast("double").alias("t"), F.col(bottom).cast("double").alias("b"))
    kind = "array<struct<o:bigint,t:double,b:double,line:int>>"

    def put(held: Column, m: Column) -> Column:
        def joins(x: Column) -> Column:
            smaller = F.least(x["b"] - x["t"], m["b"] - m["t"])
            return (smaller > 0) & ((F.least(x["b"], m["b"]) - F.greatest(x["t"], m["t"])) / smaller > least)

        hit = F.array_max(F.transform(F.filter(held, joins), lambda x: x["line"]))
        line = F.coalesce(hit, F.coalesce(F.array_max(F.transform(held, lambda x: x["line"])), F.lit(0)) + 1)
        return F.array_append(held, F.struct(m["o"].alias("o"), m["t"].alias("t"), m["b"].alias("b"), line.alias("line")))

    parts = banded(marks, page, F.least(top, bottom), F.greatest(top, bottom), 0.0)
    gathered = parts.groupBy(page, "__band").agg(F.sort_array(F.collect_list(mark)).alias("marks"))
    placed = gathered.select(page, "__band", F.explode(F.aggregate("marks", F.array().cast(kind), put)).alias("m"))
    # Lines of all bands are numbered by their first marks.
    first = placed.groupBy(page, "__band", "m.line").agg(F.min("m.o").alias("__first"))
    number = first.withColumn("__number", F.row_number().over(Window.partitionBy(page).orderBy("__first")))
    placed = placed.select(page, "__band", F.col("m.o").alias(order), F.col("m.line").alias("line")).join(number, [page, "__band", "line"])
    return placed.select(page, order, F.col("__number").alias("line"))


def stacked(marks: DataFrame, page: str, order: str, x: str, y: str, reach_x: float, reach_y: float) -> DataFrame:
    """(page, first, n, x0, x1, y0, y1): marks in order, each joined to the first box that it is within reach of; boxes
    grow by what joins them, and boxes themselves are not joined."""
    mark = F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kind = "array<struct<first:bigint,n:int,x0:double,x1:double,y0:double,y1:double>>"

    def put(held: Column, m: Column) -> Column:
        near = lambda b: (m["x"] >= b["x0"] - reach_x) & (m["x"] <= b["x1"] + reach_x) & (m["y"] >= b["y0"] - reach_y) & (m["y"] <= b["y1"] + reach_y)
        first = F.array_min(F.transform(F.filter(held, near), lambda b: b["first"]))
        grown = F.transform(
            held,
            lambda b: F.when(
                b["first"] == first,
                F.struct(b["first"].alias("first"), (b["n"] + 1).alias("n"), F.least(b["x0"], m["x"]).alias("x0"), F.greatest(b["x1"], m["x"]).alias("x1"), F.least(b["y0"], m["y"]).alias("y0"), F.greatest(b["y1"], m["y"]).alias("y1")),
            ).otherwise(b),
        )
        new = F.struct(m["o"].alias("first"), F.lit(1).alias("n"), m["x"].alias("x0"), m["x"].alias("x1"), m["y"].alias("y0"), m["y"].alias("y1"))
        return F.when(first.isNull(), F.array_append(held, new)).otherwise(grown)

    at = F.col(y).cast("double")
    gathered = banded(marks, page, at, at, reach_y).groupBy(page, "__band").agg(F.sort_array(F.collect_list(mark)).alias("marks"))
    return gathered.select(page, F.explode(F.aggregate("marks", F.array().cast(kind), put)).alias("b")).select(page, "b.*")


def distinct_shapes(shapes: DataFrame, group: str, order: str, features: list[str], width: float) -> DataFrame:
    """Rows of each group without those that are near an earlier row that stays: all features within `width`. A row
    without a group, an order or one of the features is near none. Numbers of order are distinct within a group.

    Rows lie in cells as wide as the tolerance. In each round the first row left of a cell stays if no row left in the cells
    around it comes before; then all that are near one that stays go. A cell's rows are near each other, so few of a cell
    stay and rows meet few of them: no pairs of all rows are made, and each round leaves a part of the cells only.
    """
    names = [f"__f{i}" for i in range(len(features))]
    cells = [f"__c{i}" for i in range(len(features))]
    rows = shapes.select(F.col(group).alias("__g"), F.col(order).alias("__o"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)])
    whole = F.col("__g").isNotNull() & F.col("__o").isNotNull()
    for n in names:
        whole = whole & F.col(n).isNotNull()
    left = written(rows.filter(whole).select("*", *[F.floor(F.col(n) / width).alias(c) for n, c in zip(names, cells)]), "shapes")
    stays = [rows.filter(~whole).select("__g", "__o")]
    steps = F.array(*[F.struct(*[F.lit(s).alias(c) for s, c in zip(step, cells)]) for step in product((-1, 0, 1), repeat=len(cells))])
    around = lambda df, *keep: df.select("__g", *keep, *cells, F.explode(steps).alias("__s")).select("__g", *keep, *[(F.col(c) + F.col(f"__s.{c}")).alias(c) for c in cells])
    while not left.isEmpty():
        first = left.groupBy("__g", *cells).agg(F.min(F.struct("__o", *names)).alias("m")).select("__g", *cells, "m.*")
        least = around(first, "__o").groupBy("__g", *cells).agg(F.min("__o").alias("__least"))
        safe = written(first.join(least, ["__g", *cells]).filter("__o = __least").drop("__least"), "stays")
        stays.append(safe.select("__g", "__o"))
        beside = around(safe.select("__g", *cells, *[F.col(n).alias(f"{n}s") for n in names]), *[f"{n}s" for n in names])
        near = F.col("l.__g") == F.col("s.__g")
        for c, n in zip(cells, names):
            near = near & (F.col(f"l.{c}") == F.col(f"s.{c}")) & (F.abs(F.col(f"l.{n}") - F.col(f"s.{n}s")) <= width)
        left = written(left.alias("l").join(beside.alias("s"), near, "left_anti"), "shapes")
    kept = reduce(DataFrame.unionAll, stays)
    return shapes.join(kept, F.col(group).eqNullSafe(F.col("__g")) & F.col(order).eqNullSafe(F.col("__o")), "left_semi")
