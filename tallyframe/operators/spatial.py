"""Boxes and cells: overlaps, clearances, connected regions, merged boxes, rows of cells as rectangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.components import components
from tallyframe.operators.tables import written

#: Parts that the rows of one bin are dealt into.
DEALT = 8


def dealt(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], by: str, parts: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two tables that are to meet by keys, each key's left rows dealt into DEALT parts by a column and its right rows copied
    to each, laid out alike by keys and `__deal` in several tasks for each core. Tables of few bytes can make very many
    pairs, so that neither the files nor the shuffled bytes say how many tasks are needed; or in `parts` tasks."""
    spark = left.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    left = left.withColumn("__deal", F.pmod(F.xxhash64(by), F.lit(DEALT)))
    right = right.withColumn("__to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
    return left.repartition(n, *left_keys, "__deal").hint("shuffle_merge"), right.repartition(n, *right_keys, "__to")


def spans(low: Column, high: Column, width: float) -> Column:
    """The bins of a width that an interval touches."""
    return F.sequence(F.floor(low / width), F.floor(high / width))


def overlapping(a: DataFrame, b: DataFrame, by: str, width: float, a_id: str = "id", b_id: str = "id") -> DataFrame:
    """(by, a, b) of boxes (x0, y0, x1, y1) of two tables that overlap by more than an edge.

    Boxes are put into the bins of a grid that they touch and meet in bins; of the bins that two share only the one
    with the upper left corner of what they share counts, so no pair is given twice.
    """

    def binned(df: DataFrame, key: str, name: str) -> DataFrame:
        rows = df.select(F.col(by).alias(f"{name}by"), F.col(key).alias(name), *[F.col(c).alias(name + c) for c in ("x0", "y0", "x1", "y1")])
        rows = rows.withColumn("bx", F.explode(spans(F.col(name + "x0"), F.col(name + "x1"), width)))
        return rows.withColumn("by_", F.explode(spans(F.col(name + "y0"), F.col(name + "y1"), width)))

    l_, r = dealt(binned(a, a_id, "a"), binned(b, b_id, "b").withColumnsRenamed({"bx": "rx", "by_": "ry"}), ["aby", "bx", "by_"], ["bby", "rx", "ry"], "a")
    hit = l_.join(r, (F.col("aby") == F.col("bby")) & (F.col("bx") == F.col("rx")) & (F.col("by_") == F.col("ry")) & (F.col("__deal") == F.col("__to")))
    hit = hit.filter("ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1")
    first = (F.floor(F.greatest("ax0", "bx0") / width) == F.col("bx")) & (F.floor(F.greatest("ay0", "by0") / width) == F.col("by_"))
    return hit.filter(first).select(F.col("aby").alias(by), "a", "b")


#: The corners of a box.
CORNERS = ("x0", "y0", "x1", "y1")


def told_to_all(boxes: DataFrame, by: str, found: DataFrame, otherwise: float) -> DataFrame:
    """(id, clear) of all boxes from what was found for different ones."""
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (by, *CORNERS)]
    return boxes.alias("b").join(found.alias("f"), same, "left").select("b.id", F.coalesce("f.clear", F.lit(otherwise)).alias("clear"))


def clear_above(boxes: DataFrame, ink: DataFrame, by: str, cap: float) -> DataFrame:
    """(id, clear): room from each box up to the next cell of ink in its columns, `cap` at most.

    Only cells in the strip above a box matter; they meet it in bins as high as the cap and eight times as wide. Boxes that
    are alike are looked at once.
    """
    wide = 8 * cap
    b = boxes.select(by, *CORNERS).distinct().filter("x1 > x0").withColumn("bin", F.explode(spans(F.col("y0") - cap, F.col("y0"), cap))).withColumn("bx", F.explode(spans(F.col("x0"), F.col("x1"), wide)))
    i = ink.select(F.col(by).alias("ink_by"), "x", "y").distinct().withColumn("ink_bin", F.floor(F.col("y") / cap)).withColumn("ix", F.floor(F.col("x") / wide))
    b, i = dealt(b, i, [by, "bin", "bx"], ["ink_by", "ink_bin", "ix"], "y0")
    met = (b[by] == i["ink_by"]) & (F.col("bin") == F.col("ink_bin")) & (F.col("bx") == F.col("ix")) & (F.col("__deal") == F.col("__to"))
    near = b.join(i, met & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") < F.col("y0")) & (F.col("y0") - F.col("y") <= cap))
    return told_to_all(boxes, by, near.groupBy(by, *CORNERS).agg(F.min(F.col("y0") - F.col("y")).alias("clear")), cap)


def nearest_ink(boxes: DataFrame, ink: DataFrame, by: str, cap: int) -> DataFrame:
    """(id, clear): whole steps from each box to the nearest cell, in the greater of both directions, `cap` at most. Boxes
    that are alike are looked at once, and so are cells."""
    b = boxes.select(by, *CORNERS).distinct().withColumn("bx", F.explode(spans(F.col("x0") - cap, F.col("x1") + cap, cap))).withColumn("by_", F.explode(spans(F.col("y0") - cap, F.col("y1") + cap, cap)))
    i = ink.select(F.col(by).alias("ink_by"), "x", "y").distinct().withColumn("ix", F.floor(F.col("x") / cap)).withColumn("iy", F.floor(F.col("y") / cap))
    b, i = dealt(b, i, [by, "bx", "by_"], ["ink_by", "ix", "iy"], "x1")
    away = F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), F.col("y0") - F.col("y"), F.col("y") - F.col("y1"), F.lit(0))
    near = b.join(i, (b[by] == i["ink_by"]) & (F.col("bx") == F.col("ix")) & (F.col("by_") == F.col("iy")) & (F.col("__deal") == F.col("__to")))
    found = near.groupBy(by, *CORNERS).agg(F.least(F.min(away), F.lit(cap)).alias("clear"))
    return told_to_all(boxes, by, found, cap).select("id", F.col("clear").cast("long").alias("clear"))


#: A square and its eight neighbours, as steps.
AROUND = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))


def steps_around() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AROUND])


#: Squares along the side of a tile; a tile's squares are united in one pass.
TILE = 64


def within_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squares (page, tx, ty, gx, gy), sorted by tile -> each with the first square, in reading order, of its part of
    the tile. A tile has TILE * TILE squares at most, so what is held is bounded."""
    held: list[pa.RecordBatch] = []

    def told(rows: pa.Table, page: np.ndarray) -> pa.RecordBatch:
        tx, ty, gx, gy = (rows[c].to_numpy() for c in ("tx", "ty", "gx", "gy"))
        new = np.ones(len(gx), dtype=bool)
        new[1:] = (page[1:] != page[:-1]) | (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])
        tile = np.cumsum(new)
        # A code of the place inside its tile, with a rim, so that neighbours differ by fixed steps; in reading order.
        code = (tile * (TILE + 2) + (gy - ty * TILE) + 1) * (TILE + 2) + (gx - tx * TILE) + 1
        order = np.argsort(code)
        sorted_, name = code[order], np.arange(len(code))
        pairs = []
        for step in (1, TILE + 1, TILE + 2, TILE + 3):
            at = np.minimum(np.searchsorted(sorted_, sorted_ + step), len(sorted_) - 1)
            hit = np.flatnonzero((sorted_[at] == sorted_ + step) & (tile[order[at]] == tile[order]))
            pairs.append((hit, at[hit]))
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        while True:  # take the least name of the two, then the name's own name, until all neighbours agree
            low = np.minimum(name[a], name[b])
            if np.array_equal(name[a], name[b]):
                break
            np.minimum.at(name, name[a], low)
            np.minimum.at(name, name[b], low)
            while not np.array_equal(name, name[name]):
                name = name[name]
        first = np.empty(len(code), dtype=np.int64)
        first[order] = order[name]
        return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in ("page", "gx", "gy")), pa.array(gx[first]), pa.array(gy[first])], names=["page", "gx", "gy", "rx", "ry"])

    def codes(rows: pa.Table) -> np.ndarray:
        return rows["page"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held).combine_chunks()
        if not len(rows):
            continue
        page = codes(rows)
        tx, ty = rows["tx"].to_numpy(), rows["ty"].to_numpy()
        last = np.flatnonzero((page != page[-1]) | (tx != tx[-1]) | (ty != ty[-1]))
        whole = int(last[-1]) + 1 if len(last) else 0  # the last tile may go on
        if whole:
            yield told(rows.slice(0, whole), page[:whole])
        held = rows.slice(whole).to_batches()
    rows = pa.Table.from_batches(held) if held else None
    if rows is not None and len(rows):
        yield told(rows.combine_chunks(), codes(rows))


def roots(squares: DataFrame, by: str) -> DataFrame:
    """(by, gx, gy, root) of distinct squares: the first square, in reading order, of those that hang together, corners
    included.

    Squares are united inside tiles first, in one pass; only links between squares at the rims of neighbouring tiles
    then go through rounds of joins. So rounds and what they move follow the tiles that a region crosses, not its
    squares.
    """
    kind = squares.schema[by].dataType.simpleString()
    tiled = squares.select(F.col(by).alias("page"), F.floor(F.col("gx") / TILE).alias("tx"), F.floor(F.col("gy") / TILE).alias("ty"), F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"))
    tiled = tiled.repartition("page", "tx", "ty").sortWithinPartitions("page", "tx", "ty")
    inside = written(tiled.mapInArrow(within_tiles, f"page {kind}, gx long, gy long, rx long, ry long").select("page", "gx", "gy", F.struct("page", F.col("ry").alias("gy"), F.col("rx").alias("gx")).alias("part")), "tiles")
    mx, my = F.pmod("gx", F.lit(TILE)), F.pmod("gy", F.lit(TILE))
    rim = inside.filter((mx == 0) | (mx == TILE - 1) | (my == 0) | (my == TILE - 1))
    near = rim.select("page", F.explode(steps_around()).alias("s"), "gx", "gy", "part").select("page", (F.col("gx") + F.col("s.i")).alias("gx"), (F.col("gy") + F.col("s.j")).alias("gy"), F.col("part").alias("a"))
    links = near.join(rim.withColumnRenamed("part", "b"), ["page", "gx", "gy"]).filter("a <> b").select("a", "b")
    found = components(links)
    out = inside.join(found, inside["part"] == found["node"], "left").withColumn("first", F.coalesce("root", "part"))
    return out.select(F.col("page").alias(by), "gx", "gy", F.struct(F.col("first.gy").alias("gy"), F.col("first.gx").alias("gx")).alias("root"))


def regions(cells: DataFrame, by: str, cell: int, least: int = 0) -> DataFrame:
    """(by, x0, y0, x1, y1, n): connected regions of points on a coarse grid of squares `cell` wide, corners included.

    Regions of fewer than `least` points are left out.
    """
    x, y = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    squares = cells.groupBy(F.col(by), x.alias("gx"), y.alias("gy")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))
    squares = written(squares, "squares")
    held = roots(squares, by)
    whole = squares.join(held, [by, "gx", "gy"]).groupBy(by, "root").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n"))
    return whole.filter(F.col("n") >= least).drop("root")


def labelled(cells: DataFrame, by: str) -> DataFrame:
    """(by, x, y, label): the connected part that each point belongs to, corners included, numbered from 1 on each page
    in reading order of first points. Points given twice count once."""
    held = roots(written(cells.select(by, F.col("x").alias("gx"), F.col("y").alias("gy")).distinct(), "points"), by)
    number = held.select(by, "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy(by).orderBy("root")))
    return held.join(number, [by, "root"]).select(by, F.col("gx").alias("x"), F.col("gy").alias("y"), "label")


def blobs(raster: DataFrame, by: str, ink: int, paper: int) -> DataFrame:
    """(by, label, n, cx, cy, clipped) of the connected parts darker than `ink` in a window of points (by, x, y, level).

    A part is clipped where a neighbour of it is not in the window. Its centre weighs the part and the ring of points
    around it by how much darker than `paper` they are, points being squares of side 1 with their corner at (x, y).
    """
    parts = labelled(raster.filter(F.col("level") < ink), by)
    near = parts.select(by, "label", "x", "y", F.explode(steps_around()).alias("s"))
    own = (F.col("s.i") == 0) & (F.col("s.j") == 0)
    near = near.groupBy(by, "label", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y")).agg(F.max(own).alias("own"))
    seen = near.join(raster.select(by, "x", "y", "level"), [by, "x", "y"], "left")
    seen = seen.withColumn("dark", F.coalesce(F.greatest(paper - F.col("level"), F.lit(0)), F.lit(0)))
    x, y, mine = F.col("x") + 0.5, F.col("y") + 0.5, F.col("own")
    weight = F.sum("dark")
    centre = lambda at: F.when(weight > 0, F.sum(F.col("dark") * at) / weight).otherwise(F.avg(F.when(mine, at)))
    return seen.groupBy(by, "label").agg(F.count(F.when(mine, 1)).alias("n"), centre(x).alias("cx"), centre(y).alias("cy"), F.max(F.col("level").isNull()).alias("clipped"))


def merged_boxes(boxes: DataFrame, by: str, width: float) -> DataFrame:
    """Boxes (by, id, x0, y0, x1, y1) with those that overlap put together, again and again until none do.

    A round puts together all boxes that hang together by overlaps, so the next one has only to see to what the larger
    boxes now touch; there are fewer boxes each time, so it ends.
    """
    held = written(boxes, "boxes")
    while True:
        node = lambda c: F.struct(by, F.col(c).alias("id"))
        pairs = written(overlapping(held, held, by, width).filter("a < b").select(node("a").alias("a"), node("b").alias("b")), "overlaps")
        if pairs.isEmpty():
            return held
        root = components(pairs).select(F.col(f"node.{by}").alias(by), F.col("node.id").alias("id"), F.col("root.id").alias("to"))
        named = held.join(root, [by, "id"], "left").withColumn("to", F.coalesce("to", "id"))
        held = written(named.groupBy(by, F.col("to").alias("id")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")), "boxes")


def without_dust(letters: DataFrame, line: str, height: str, least: float) -> DataFrame:
    """The rows of lines that have a letter of at least a height."""
    big = F.max(F.col(height) >= least).over(Window.partitionBy(line))
    return letters.withColumn("__big", big).filter("__big").drop("__big")


def row_rectangles(cells: DataFrame, by: str) -> DataFrame:
    """(by, y, x0, x1): runs of neighbouring cells of each row."""
    island = F.col("x") - F.row_number().over(Window.partitionBy(by, "y").orderBy("x"))
    return cells.select(by, "x", "y").distinct().withColumn("i", island).groupBy(by, "y", "i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("i")


def owners(small: DataFrame, base: DataFrame, by: str, reach: float) -> DataFrame:
    """(small, base): the base mark of the same row whose centre is nearest to a small one's within reach; of equals
    the first."""
    s = small.withColumn("bin", F.explode(spans(F.col("cx") - reach, F.col("cx") + reach, reach)))
    b = base.select(F.col(by).alias("b_by"), F.col("id").alias("base"), F.col("cx").alias("bcx"), F.floor(F.col("cx") / reach).alias("b_bin"))
    near = s.join(b, (s[by] == b["b_by"]) & (F.col("bin") == F.col("b_bin")) & (F.abs(F.col("cx") - F.col("bcx")) <= reach))
    return near.groupBy(F.col("id").alias("small")).agg(F.min_by("base", F.struct(F.abs(F.col("cx") - F.col("bcx")), "base")).alias("base"))

