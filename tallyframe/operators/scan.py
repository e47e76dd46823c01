"""Running values over the ordered rows of groups, where one group may hold any part of all rows.

A window over a group brings the group to one task. Here rows are dealt out by ranges of group and order, so that a large
group lies in many parts; each part is scanned by itself, and what the parts before hold of a group is carried over from
a table that has at most two rows a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.tables import parts_for, written

#: The columns that `dealt` adds: the place of a row, and its part.
AT, PART = "__at", "__part"

#: How to fold a column over rows, and how to put together what came before the part and what is in it.
FOLDS = {
    "sum": (F.sum, lambda carried, own: F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "max": (F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda carried, own: F.coalesce(own, carried)),
}


def dealt(df: DataFrame, by: list[str], order: list[str], name: str = "dealt", parts: int = 0) -> DataFrame:
    """`df` written in ranges of (by, order), with `__at`, which rises in that order, and `__part`. Rows that tie in all of
    these keep the place that they got. There are `parts` ranges, or as many as a shuffle has tasks."""
    n = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*by, *order]
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(AT, F.monotonically_increasing_id())
    return written(placed, name).withColumn(PART, F.shiftright(AT, 33))


def before(rows: DataFrame, by: list[str], **folds: tuple[str, Column]) -> DataFrame:
    """Add columns to rows of `dealt`: name=(fold, column) is the sum, the largest or the last (that isn't null) of a column
    over the rows of the group that come before; a sum of none is 0, the others are null then."""
    w = Window.partitionBy(PART, *by).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[FOLDS[how][0](c).over(w).alias(f"__own_{name}") for name, (how, c) in folds.items()])
    # A group that goes on in another part is the last of one part and the first of the next.
    group = F.struct(*by)
    edges = rows.groupBy(PART).agg(F.array_distinct(F.array(F.min(group), F.max(group))).alias("__g"))
    edges = edges.select(F.col(PART).alias("__p"), F.explode("__g").alias("__g"))
    same = lambda key: (F.col(PART) == F.col("__p")) & F.struct(*by).eqNullSafe(F.col(key))
    whole = lambda how, c: F.max_by(c, F.when(c.isNotNull(), F.col(AT))) if how == "last" else FOLDS[how][0](c)
    held = rows.join(F.broadcast(edges), same("__g")).groupBy("__p", "__g").agg(*[whole(how, c).alias(name) for name, (how, c) in folds.items()])
    earlier = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select("__p", "__g", *[FOLDS[how][0](F.col(name)).over(earlier).alias(f"__carried_{name}") for name, (how, _) in folds.items()])
    both = local.join(F.broadcast(carried), same("__g"), "left")
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], *[FOLDS[how][1](F.col(f"__carried_{name}"), F.col(f"__own_{name}")).alias(name) for name, (how, _) in folds.items()])


def placed(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Add the number of each row in its group, from 1, and drop nothing else."""
    n = parts_for(df.sparkSession, df.count())
    rows = before(dealt(df, by, order, parts=n).repartition(n, PART, *by), by, **{"__n": ("sum", F.lit(1))})
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__n") + 1).cast("long").alias(name))
