"""Runs, gaps and sessions in ordered rows, by scans that no group has to be in one task for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import scan
from tallyframe.operators.fits import elements, part_of
from tallyframe.operators.tables import written


def runs(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """Runs of consecutive whole numbers in each group: (first, last)."""
    rows = df.select(*by, n).distinct()
    island = F.col(n) - F.row_number().over(Window.partitionBy(*by).orderBy(n))
    return rows.withColumn("island", island).groupBy(*by, "island").agg(F.min(n).alias("first"), F.max(n).alias("last")).drop("island")


def compacted(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """Each group's numbers as words: `a to b` for three or more in a row, `a and b` for a lone pair, else single ones."""
    found = runs(df, by, n)
    lone = F.count("*").over(Window.partitionBy(*by)) == 1
    text = lambda c: F.col(c).cast("string")
    items = (
        F.when(F.col("first") == F.col("last"), F.array(text("first")))
        .when(F.col("last") - F.col("first") >= 2, F.array(F.concat(text("first"), F.lit(" to "), text("last"))))
        .when(lone, F.array(F.concat(text("first"), F.lit(" and "), text("last")))).otherwise(F.array(text("first"), text("last")))
    )
    gathered = found.select(*by, F.struct("first", items.alias("items")).alias("s")).groupBy(*by).agg(F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["items"])).alias("items"))
    size = F.size("items")
    joined = F.when(size == 1, F.col("items")[0]).otherwise(F.concat(F.array_join(F.slice("items", 1, size - 1), ", "), F.lit(" and "), F.element_at("items", -1)))
    return gathered.select(*by, joined.alias("said"))


def bands(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Stretches of rows with one value of a flag: (flag, first, last, n)."""
    rows = scan.before(scan.dealt(df.select(*by, order, flag), by, [order], "bands"), by, __was=("last", F.struct(F.col(flag).alias("f"))))
    change = (~F.col("__was.f").eqNullSafe(F.col(flag)) | F.col("__was").isNull()).cast("int")
    marked = scan.before(rows.withColumn("__change", change), by, __band=("sum", F.col("__change")))
    return marked.groupBy(*by, (F.col("__band") + F.col("__change")).alias("__band")).agg(F.first(flag).alias(flag), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__band")


def longest_run(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """The most rows in a row with the flag, 0 for groups without."""
    found = bands(df, by, order, flag)
    return found.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col(flag), F.col("n"))), F.lit(0)).alias("longest"))


def reached(df: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Rows in order of `left`, then `right`, as of `scan.dealt`, with `__reached`: the farthest end before, null at first."""
    return scan.before(scan.dealt(df, by, [left, right], "intervals"), by, __reached=("max", F.col(right)))


def wide_gaps(df: DataFrame, by: list[str], left: str, right: str, least: float) -> DataFrame:
    """Stretches of at least `least` that no interval of the group covers, between its intervals."""
    return reached(df.select(*by, left, right), by, left, right).select(*by, F.col("__reached").alias("from"), F.col(left).alias("to")).filter(F.col("to") - F.col("from") >= least)


def gap_sessions(df: DataFrame, by: list[str], left: str, right: str, limit: Column | float) -> DataFrame:
    """Add `session`, from 1: a new one begins where a row starts over `limit` after the farthest end before it."""
    return sessions(reached(df, by, left, right), by, left, limit).select(*[F.col(f"`{c}`") for c in df.columns], "session")


def sessions(rows: DataFrame, by: list[str], left: str, limit: Column | float) -> DataFrame:
    """Add `session` to rows of `reached`."""
    starts = F.coalesce((F.col(left) - F.col("__reached") > limit).cast("long"), F.lit(1))
    found = scan.before(rows.withColumn("__starts", starts), by, __sessions=("sum", F.col("__starts")))
    return found.withColumn("session", F.col("__sessions") + F.col("__starts"))


def own_sessions(df: DataFrame, by: list[str], left: str, right: str, height: str, floor: float = 0.3) -> DataFrame:
    """`gap_sessions` by the limits of `data_limits`, from rows that are put in order once."""
    rows = written(reached(df, by, left, right), "reached")
    found = written(limits(rows, by, F.col(left) - F.col("__reached"), height, floor), "limits")
    limited = rows.join(found, by)
    return sessions(limited, by, left, F.col("gap_limit")).select(*[F.col(f"`{c}`") for c in df.columns], "session")


def data_limits(df: DataFrame, by: list[str], left: str, right: str, height: str, floor: float = 0.3) -> DataFrame:
    """Each group's gap limit: 2.2 times its upper median gap, 0.45 times its lower quartile height, and a floor, the
    greatest of them; groups with fewer than four gaps have the floor only."""
    return limits(reached(df, by, left, right), by, F.col(left) - F.col("__reached"), height, floor)


def limits(rows: DataFrame, by: list[str], gap: Column, height: str, floor: float) -> DataFrame:
    """`data_limits` of rows whose gaps are known. Gaps and heights are two kinds of values of one selection."""
    both = rows.select(*by, F.explode(F.array(F.struct(F.lit("gap").alias("kind"), gap.cast("double").alias("v")), F.struct(F.lit("height").alias("kind"), F.col(height).cast("double").alias("v")))).alias("e")).select(*by, "e.kind", "e.v")
    index = F.when(F.col("kind") == "gap", part_of(1, 2)).otherwise(part_of(1, 4))
    found = elements(both, [*by, "kind"], "v", {"v": index})
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    own = F.greatest(2.2 * of("gap", "v"), 0.45 * of("height", "v"), F.lit(floor))
    return found.groupBy(*by).agg(F.when(F.coalesce(of("gap", "n"), F.lit(0)) < 4, F.lit(floor)).otherwise(own).alias("gap_limit"))


def hierarchical_numbers(df: DataFrame, by: str, order: str, level: str, depth: int) -> DataFrame:
    """Add `numbers`: counters of the levels from 1 to a row's own, each begun again after a row of a higher level.

    A level's counter is how many of its rows came so far, less those that had come when it last began again."""
    at = lambda c, k: (F.col(level) == k).cast("int") if c == "own" else (F.col(level) < k).cast("int")
    rows = scan.dealt(df, [by], [order], "levels")
    counted = scan.before(rows, [by], **{f"__n{k}": ("sum", at("own", k)) for k in range(1, depth + 1)})
    began = scan.before(counted, [by], **{f"__was{k}": ("last", F.when(F.col(level) < k, F.col(f"__n{k}"))) for k in range(2, depth + 1)})
    number = lambda k: F.col(f"__n{k}") + at("own", k) - (F.coalesce(F.col(f"__was{k}"), F.lit(0)) if k > 1 else F.lit(0))
    numbers = F.array_join(F.slice(F.array(*[number(k).cast("string") for k in range(1, depth + 1)]), F.lit(1), F.col(level).cast("int")), ".")
    return began.withColumn("numbers", numbers).select(*[F.col(f"`{c}`") for c in df.columns], "numbers")


def inversions(df: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """The first place of each group where a value is over the next one; only in groups where all rows have a value."""
    rows = scan.dealt(df.select(*by, F.col(order).alias("__order"), value.alias("v")), by, ["__order"], "values")
    rows = scan.before(rows, by, __was=("last", F.struct("__order", "v")))
    out = rows.groupBy(*by).agg(F.min(F.when(F.col("__was.v") > F.col("v"), F.col("__was.__order"))).alias("at"), F.count_if(F.col("v").isNull()).alias("without"))
    return out.filter("without = 0 AND at IS NOT NULL").drop("without")


def offsets(df: DataFrame, by: list[str], order: str, size: str) -> DataFrame:
    """Add `starts`: 1 plus the sizes of the rows before."""
    rows = scan.before(scan.dealt(df, by, [order], "sizes"), by, __starts=("sum", F.col(size)))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (1 + F.col("__starts")).alias("starts"))


def neighbour_gaps(df: DataFrame, by: list[str], value: str, ties: str) -> DataFrame:
    """Add `gap` to each row but the last of its group: how far the next value is."""
    rows = scan.dealt(df, by, [value, ties], "values")
    held = scan.before(rows, by, __was=("last", F.struct(*[F.col(f"`{c}`") for c in df.columns]))).filter("__was IS NOT NULL")
    return held.select("__was.*", (F.col(value) - F.col(f"__was.{value}")).alias("gap"))
