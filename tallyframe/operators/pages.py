"""Pages of several documents put together, sheets paired with pages, and what differs between two pages of ink.

All of it is done for many jobs at once; what can't be done for a job is a row that says why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import spatial
from tallyframe.operators.tables import parts_for

#: Fixed value: pages whose sides differ by no more than a point are the same paper.
SAME_PAPER = 1.0


def merged(files: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files (job, pos, file, digest) in order of `pos` and their pages (job, pos, page, width, height, content), page from 1:

    * what lies on each merged page, (job, page, pos, content, width, height), in the first file's size; files that have no
      page there add nothing;
    * one row for each job that is refused, (job, why, page, first, other): fewer than two files, a file without pages, or
      a page of another size than the first file's that has it, the first such page and file. Refused jobs have no pages;
    * (job, file, n_pages, is_short, same_as) of each file of the others: short of the longest, and the first earlier
      file with the same digest.

    Every step is dealt out to tasks of bounded rows.
    """
    spark = files.sparkSession
    n_files, n_rows = parts_for(spark, files.count()), parts_for(spark, pages.count())
    each = pages.repartition(n_rows, "job", "page")
    sizes = each.groupBy("job", "page").agg(F.min_by(F.struct("pos", "width", "height"), "pos").alias("one"))
    laid = each.join(sizes.hint("shuffle_merge"), ["job", "page"])
    other = (F.abs(F.col("width") - F.col("one.width")) > SAME_PAPER) | (F.abs(F.col("height") - F.col("one.height")) > SAME_PAPER)
    lengths = pages.select("job", "pos").repartition(n_files, "job", "pos").groupBy("job", "pos").agg(F.count("*").alias("n_pages"))
    counted = files.repartition(n_files, "job", "pos").join(lengths.hint("shuffle_merge"), ["job", "pos"], "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    jobs = counted.select("job", "pos", "n_pages").repartition(n_files, "job").groupBy("job").agg(F.count("*").alias("n"), F.min(F.when(F.col("n_pages") == 0, F.col("pos"))).alias("blank"), F.max("n_pages").alias("deepest"))
    nothing = F.lit(None).cast(files.schema["pos"].dataType)
    why = F.struct(F.lit(0).alias("order"), F.lit(0).cast("long").alias("page"), F.coalesce("blank", nothing).alias("pos"), nothing.alias("first"), F.when(F.col("n") < 2, "too few").otherwise("blank").alias("why"))
    faults = jobs.filter("n < 2 OR blank IS NOT NULL").select("job", why.alias("w")).unionByName(laid.filter(other).select("job", F.struct(F.lit(1).alias("order"), F.col("page").cast("long").alias("page"), "pos", F.col("one.pos").alias("first"), F.lit("different paper").alias("why")).alias("w")))
    refused = faults.repartition(n_files, "job").groupBy("job").agg(F.min("w").alias("w")).select("job", "w.why", F.when(F.col("w.page") > 0, F.col("w.page")).alias("page"), F.col("w.first").alias("first"), F.when(F.col("w.why") != "too few", F.col("w.pos")).alias("other"))
    # A job may have most of the rows: they are dealt out, and what is known of the job goes along with each share.
    shares, out = spatial.dealt(laid, refused.select(F.col("job").alias("__job")), ["job"], ["__job"], "pos", n_rows)
    put = shares.join(out, (F.col("job") == F.col("__job")) & (F.col("__deal") == F.col("__to")), "left_anti").select("job", "page", "pos", "content", "one.width", "one.height")
    earliest = files.repartition(n_files, "job", "digest").groupBy("job", "digest").agg(F.min_by("file", "pos").alias("same_as"), F.min("pos").alias("at"))
    accepted = jobs.join(refused.select("job").hint("shuffle_merge"), "job", "left_anti").select(F.col("job").alias("__job"), "deepest")
    shares, known = spatial.dealt(counted, accepted, ["job"], ["__job"], "pos", n_files)
    told = shares.join(known, (F.col("job") == F.col("__job")) & (F.col("__deal") == F.col("__to"))).repartition(n_files, "job", "digest").join(earliest.hint("shuffle_merge"), ["job", "digest"], "left")
    return put, refused, told.select("job", "file", "n_pages", (F.col("n_pages") < F.col("deepest")).alias("is_short"), F.when(F.col("at") < F.col("pos"), F.col("same_as")).alias("same_as"))


def paired(sheets: DataFrame, pages: DataFrame) -> DataFrame:
    """Sheets (job, sheet), from 1, with the pages (job, page) of what was to be on them: (job, sheet, page, why). A single
    page goes with every sheet, as many pages as sheets go one to one; any other number is an error, told once for a job
    with its sheet and page null."""
    n = sheets.groupBy("job").agg(F.count("*").alias("n_sheets")).join(pages.groupBy("job").agg(F.count("*").alias("n_pages")), "job", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    good = (F.col("n_pages") == 1) | (F.col("n_pages") == F.col("n_sheets"))
    matched = sheets.join(n.filter(good), "job").select("job", "sheet", F.when(F.col("n_pages") == 1, 1).otherwise(F.col("sheet")).cast("long").alias("page"), F.lit(None).cast("string").alias("why"))
    nothing = F.lit(None).cast("long")
    said = F.concat(F.col("n_sheets").cast("string"), F.lit(" sheets, "), F.col("n_pages").cast("string"), F.lit(" pages"))
    return matched.unionByName(n.filter(~good).select("job", nothing.cast(sheets.schema["sheet"].dataType).alias("sheet"), nothing.alias("page"), said.alias("why")))


def runs_of(cells: DataFrame) -> DataFrame:
    """Cells (page, x, y) as stretches of each row: (page, y, x0, x1)."""
    w = Window.partitionBy("page", "y").orderBy("x")
    island = F.col("x") - F.row_number().over(w)
    return cells.select("page", "y", "x").distinct().withColumn("island", island).groupBy("page", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def joined_runs(runs: DataFrame) -> DataFrame:
    """Stretches of each row, those that overlap or touch as one."""
    w = Window.partitionBy("page", "y").orderBy("x0", "x1")
    reached = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.withColumn("begins", F.coalesce((F.col("x0") > reached + 1).cast("int"), F.lit(1)))
    return begun.withColumn("island", F.sum("begins").over(w)).groupBy("page", "y", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("island")


def grown_runs(runs: DataFrame, radius: int) -> DataFrame:
    """Stretches grown by a radius in all directions: longer, and on as many rows above and below. A stretch becomes
    2 * radius + 1 rows, whatever its length."""
    rows = F.explode(F.sequence(F.col("y") - radius, F.col("y") + radius)).alias("y")
    return joined_runs(runs.select("page", rows, (F.col("x0") - radius).alias("x0"), (F.col("x1") + radius).alias("x1")))


def without_runs(runs: DataFrame, taken: DataFrame) -> DataFrame:
    """What is left of stretches outside those that are taken, which don't overlap one another."""
    held = taken.select(F.col("page").alias("p"), F.col("y").alias("r"), F.col("x0").alias("t0"), F.col("x1").alias("t1"))
    met = runs.join(held, (F.col("page") == F.col("p")) & (F.col("y") == F.col("r")) & (F.col("t0") <= F.col("x1")) & (F.col("t1") >= F.col("x0")), "left")
    over = met.groupBy("page", "y", "x0", "x1").agg(F.sort_array(F.collect_list(F.when(F.col("t0").isNotNull(), F.struct("t0", "t1")))).alias("t"))
    begins = F.concat(F.array("x0"), F.transform("t", lambda t: t["t1"] + 1))
    ends = F.concat(F.transform("t", lambda t: t["t0"] - 1), F.array("x1"))
    pieces = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("x0"), b.alias("x1"))), lambda s: s["x0"] <= s["x1"])
    return over.select("page", "y", F.explode(pieces).alias("s")).select("page", "y", "s.x0", "s.x1")


def within(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """What of stretches lies inside each page's (page, width, height), from its upper left corner."""
    inside = runs.join(sizes, "page").filter("y >= 0 AND y < height AND x0 < width AND x1 >= 0")
    return inside.select("page", "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.col("width") - 1).alias("x1"))


def differences(before: DataFrame, now: DataFrame, radius: int, before_sizes: DataFrame, now_sizes: DataFrame) -> DataFrame:
    """(page, side, y, x0, x1): ink of each of two states of pages, as stretches (page, y, x0, x1), with no ink of the other
    within a radius in both directions; `added` is new, `removed` is gone. Only the area that both sizes (page, width,
    height) have in common is compared, and pages that both have."""
    common = before_sizes.join(now_sizes.withColumnsRenamed({"width": "w", "height": "h"}), "page").select("page", F.least("width", "w").alias("width"), F.least("height", "h").alias("height"))
    old, new = within(before, common), within(now, common)
    return without_runs(new, grown_runs(old, radius)).withColumn("side", F.lit("added")).unionByName(without_runs(old, grown_runs(new, radius)).withColumn("side", F.lit("removed"))).select("page", "side", "y", "x0", "x1")
