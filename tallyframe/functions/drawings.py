"""What drawings and placed texts cover, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.measure import colour

#: Fixed value: the largest type (pt).
BIGGEST_TYPE = 4000.0


def bounds(kind: Column, a: Column, b: Column, c: Column, d: Column, points: Column, width: Column) -> Column:
    """(x0, y0, x1, y1) that a drawing covers, half its line width (mm) around: a line from (a, b) to (c, d); a rect at
    (a, b), c wide and d high, either of which may be negative; an ellipse around (a, b) with radii c and d; a path
    through points (x, y), at 0 without any. Null for another kind."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    none = F.coalesce(F.size(points), F.lit(0)) == 0
    low = lambda v: F.when(none, 0.0).otherwise(F.array_min(v))
    high = lambda v: F.when(none, 0.0).otherwise(F.array_max(v))

    def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.struct((x0 - width / 2).alias("x0"), (y0 - width / 2).alias("y0"), (x1 + width / 2).alias("x1"), (y1 + width / 2).alias("y1"))

    return (
        F.when(kind == "line", box(F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d)))
        .when(kind == "rect", box(F.least(a, a + c), F.least(b, b + d), F.greatest(a, a + c), F.greatest(b, b + d)))
        .when(kind == "ellipse", box(a - F.abs(c), b - F.abs(d), a + F.abs(c), b + F.abs(d)))
        .when(kind == "path", box(low(xs), low(ys), high(xs), high(ys)))
    )


def finite(*numbers: Column) -> Column:
    """Whether all are numbers, neither null nor NaN nor infinite."""
    out = F.lit(True)
    for n in numbers:
        out = out & F.coalesce(~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(False))
    return out


def text_fault(x: Column, y: Column, size: Column, page: Column, pages: Column) -> Column:
    """What is wrong with a placed text, the first of: position, size, page; null if nothing is."""
    return F.when(~finite(x, y, size), "position").when((size <= 0) | (size > BIGGEST_TYPE), "size").when((page < 1) | (page > pages), "page")


def drawing_fault(kind: Column, box: Column, points: Column, width: Column, stroke: Column, fill: Column, page: Column, pages: Column) -> Column:
    """What is wrong with a drawing, the first of: page, width, nothing to see, colour, position, points; null if nothing is."""
    bad = lambda c: c.isNotNull() & colour(c).isNull()
    return (
        F.when((page < 1) | (page > pages), "page").when(~finite(width) | (width < 0), "width").when(stroke.isNull() & fill.isNull(), "nothing to see")
        .when(bad(stroke) | bad(fill), "colour").when(~finite(box["x0"], box["y0"], box["x1"], box["y1"]), "position").when((kind == "path") & (F.coalesce(F.size(points), F.lit(0)) < 2), "points")
    )
