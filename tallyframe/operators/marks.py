"""Marks on a page: from labelled points, of outlines, and small ones that belong to larger ones."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.measure import overlap
from tallyframe.operators.tables import written


def marks(points: DataFrame, by: list[str], x: Column, y: Column, per_mm: float) -> DataFrame:
    """(by, x, y, w, h, ink) of labelled points: the box of the points themselves, half a point around their centres, and
    the area that they cover."""
    half = 0.5 / per_mm
    got = points.groupBy(*by).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"), F.count("*").alias("n"))
    return got.select(*by, (F.col("x0") - half).alias("x"), (F.col("y0") - half).alias("y"), (F.col("x1") - F.col("x0") + 2 * half).alias("w"), (F.col("y1") - F.col("y0") + 2 * half).alias("h"), (F.col("n") / (per_mm * per_mm)).alias("ink"))


def shapes_of(outlines: DataFrame, by: list[str], x: str, y: str, per_em: float, cap_height: float) -> DataFrame:
    """(by, height, aspect, sits) of each character's outline points: its height to that of capitals, its width to its height,
    and how far its foot sits above the base line, in ems. Characters of white space, or without height, have none."""
    got = outlines.groupBy(*by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).filter("y1 > y0")
    tall = F.col("y1") - F.col("y0")
    return got.select(*by, (tall / per_em / cap_height).alias("height"), ((F.col("x1") - F.col("x0")) / tall).alias("aspect"), (F.col("y0") / per_em).alias("sits"))


def by_page(items: DataFrame, page: str, line: str, pages: int) -> DataFrame:
    """(page, lines, said): what is laid out on each of a document's pages; items of pages that it hasn't got are left out,
    and pages without items have no lines."""
    spine = items.sparkSession.range(1, pages + 1).select(F.col("id").cast(dict(items.dtypes)[page]).alias(page))
    got = items.groupBy(page).agg(F.count("*").alias("lines"), F.max(line).alias("last"))
    return spine.join(got, page, "left").select(page, F.coalesce("lines", F.lit(0)).alias("lines"), "last")


def belongs(base: str, mark: str) -> Column:
    """Whether a mark may belong to a base (columns x, y, w, h behind a prefix): much smaller, over its width and a bit
    beyond, and clear above or below it, not far."""
    c = lambda p, k: F.col(f"{p}{k}")
    reach = c(base, "h") * 0.3
    over = overlap(c(base, "x") - reach, c(base, "x") + c(base, "w") + reach, c(mark, "x"), c(mark, "x") + c(mark, "w")) >= 0.5
    foot, mark_foot = c(base, "y") + c(base, "h"), c(mark, "y") + c(mark, "h")
    above, below = mark_foot <= c(base, "y") + c(base, "h") * 0.25, c(mark, "y") >= foot - c(base, "h") * 0.05
    near = F.when(above, c(base, "y") - mark_foot < c(base, "h") * 0.5).when(below, c(mark, "y") - foot < c(base, "h") * 0.3).otherwise(False)
    return (c(mark, "h") <= c(base, "h") * SMALLER) & over & near


#: A mark is this much smaller than its base at least; heights are parted into classes by it. Boxes that the first round
#: looks at on each side of a mark's centre, about, and by how much a round reaches further than the one before.
SMALLER, FIRST, WIDER = 0.55, 16, 4.0


def height_class(h: Column) -> Column:
    return F.floor(F.ln(h) / -math.log(SMALLER)).cast("int")


def grid_of(kind: Column) -> Column:
    """Height of the bins in which bases of a height class look for marks: as far as the least of them reaches above itself."""
    return F.exp(kind * -math.log(SMALLER)) * 0.75


def nearest_bases(found: DataFrame, page: str, width: float) -> DataFrame:
    """(page, x, y, w, h, owner): for each box of marks that may belong to bases, the base whose centre is nearest across,
    of equals the first by height and id.

    Marks that are alike are looked at once. Bases lie in bins of their height class, of where a mark's foot would be above
    them or its head below, and of their centre across; a mark looks into the bins within a radius of its centre. What is
    found within the radius is nearer than all else, and only marks without go into the next round with a wider one, until
    no base reaches as far. So a mark meets the bases about it and not all that it might belong to.
    """
    box = ["x", "y", "w", "h"]
    boxes = written(found.dropna(subset=[page, *box]).groupBy(page, *box).agg(F.min("id").alias("id")), "boxes")
    middle = F.col("x") + F.col("w") / 2
    pages = boxes.groupBy(page).agg(F.count("*").alias("n"), (F.max(middle) - F.min(middle)).alias("extent"), F.max("h").alias("tallest"), F.max(F.col("w") / 2 + F.greatest("h", F.lit(0.0)) * 0.3).alias("b"), F.max(F.col("w") / 2).alias("m"))
    about = pages.agg(F.max_by(F.col("extent") / F.col("n"), "n").alias("each"), F.max(F.col("b") + F.col("m")).alias("far")).first()
    far = about["far"] or 0.0
    radius = max(min(width, (about["each"] or 0.0) * FIRST), far / WIDER**8, 1e-9)
    kind, reach = F.col("kind"), F.col("bh") * 1e-6
    b = boxes.filter("h > 0").select(F.col(page).alias("bp"), *[F.col(c).alias(f"b{c}") for c in ["id", *box]]).withColumn("kind", height_class(F.col("bh")))
    foot = F.col("by") + F.col("bh")
    zone = lambda no, low, high: F.transform(F.sequence(F.floor((low - reach) / grid_of(kind)), F.floor((high + reach) / grid_of(kind))), lambda v: F.struct(F.lit(no).alias("zone"), v.alias("row")))
    b = b.withColumn("z", F.explode(F.concat(zone(0, F.col("by") - F.col("bh") * 0.5, F.col("by") + F.col("bh") * 0.25), zone(1, foot - F.col("bh") * 0.05, foot + F.col("bh") * 0.3)))).select("*", "z.*").drop("z")
    kinds = b.groupBy("bp").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))  # a few dozen, whatever the marks
    m = boxes.join(kinds, F.col(page) == F.col("bp")).drop("bp").join(pages.select(F.col(page).alias("tp"), "tallest"), F.col(page) == F.col("tp")).filter(F.col("h") <= F.col("tallest") * SMALLER)
    least = F.when(F.col("h") > 0, F.floor(F.ln(F.when(F.col("h") > 0, F.col("h") / SMALLER)) / -math.log(SMALLER) - 1e-6))
    left = written(m.select(F.col(page).alias("mp"), F.filter("kinds", lambda k: k >= F.coalesce(least, k)).alias("kinds"), *[F.col(c).alias(f"m{c}") for c in ["id", *box]]), "open")
    done, n = [], max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * found.sparkSession.sparkContext.defaultParallelism)
    while True:
        last = radius >= far
        column = lambda x, w: F.floor((x + w / 2) / radius)  # noqa: B023, E731
        bases = b.withColumn("column", column(F.col("bx"), F.col("bw"))).repartition(n, "bp", "kind", "zone", "row", "column")
        asked = left.withColumn("mk", F.explode("kinds"))
        asked = asked.withColumn("z", F.explode(F.array(*[F.struct(F.lit(no).alias("mz"), F.floor(v / grid_of(F.col("mk"))).alias("mr")) for no, v in ((0, F.col("my") + F.col("mh")), (1, F.col("my")))]))).select("*", "z.*")
        at = column(F.col("mx"), F.col("mw"))
        asked = asked.withColumn("mc", F.explode(F.sequence(at - 1, at + 1))).drop("kinds", "z").repartition(n, "mp", "mk", "mz", "mr", "mc")
        same = [F.col(x) == F.col(y) for x, y in (("bp", "mp"), ("kind", "mk"), ("zone", "mz"), ("row", "mr"), ("column", "mc"))]
        pairs = bases.hint("shuffle_merge").join(asked, same).filter(belongs("b", "m"))
        apart = F.abs(F.col("bx") + F.col("bw") / 2 - F.col("mx") - F.col("mw") / 2)
        best = pairs.groupBy("mp", "mid").agg(F.min(F.struct(apart.alias("a"), (-F.col("bh")).alias("h"), "bid")).alias("best"))
        best = best if last else best.filter(F.col("best.a") < radius * (1 - 1e-9))
        found_ = left.join(best, ["mp", "mid"], "left")
        judged = written(found_.select("mp", "mid", "kinds", *[f"m{c}" for c in box], F.col("best.bid").alias("owner")), "judged", F.col("owner").isNull())
        done.append(judged.filter("owner IS NOT NULL"))
        if last or not judged.any:
            break
        left, radius = judged.filter("owner IS NULL").drop("owner"), radius * WIDER
    return reduce(DataFrame.unionByName, done).select(F.col("mp").alias(page), *[F.col(f"m{c}").alias(c) for c in box], "owner")


def owned(found: DataFrame, page: str, width: float) -> DataFrame:
    """(page, id, owner) of marks (page, id, x, y, w, h): each small mark belongs to the base whose centre is nearest across,
    of equals the first by height and id; owner is null for those that belong to none.

    A base that is owned itself owns nothing: its claims are released, from the tallest down, so what stands under a
    released mark is owned again. As a base is nearly twice as tall as what it owns, chains are short; each round
    settles the marks whose base is settled.
    """
    best = nearest_bases(found, page, width)
    claims = found.join(best, [page, "x", "y", "w", "h"], "left").select(page, "id", "owner")
    state = written(claims.withColumn("free", F.when(F.col("owner").isNull(), True)), "claims")
    while not state.filter("free IS NULL").isEmpty():
        known = state.select(F.col(page).alias("kp"), F.col("id").alias("kid"), F.col("free").alias("base_free"))
        new = state.join(known, (F.col(page) == F.col("kp")) & (F.col("owner") == F.col("kid")), "left")
        state = written(new.select(page, "id", "owner", F.coalesce("free", ~F.col("base_free")).alias("free")), "claims")
    return state.select(page, "id", F.when(~F.col("free"), F.col("owner")).alias("owner"))
