"""Checks with a severity, a code, a page and words: rules give rows of them, which are gathered, thinned and ordered.

Every rule is a function from a table of pages to rows (severity, code, page, detail); page 0 stands for the whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.tables import parts_for

#: Order of severities; ink that counts as moved (mm2), share of dark under words, least slack (mm),
#: share of a page that is much.
SEVERITIES = ("blocker", "warning", "note")
MOVED, DARK, SLACK, MUCH = 1.5, 0.35, 2.0, 0.06


def found(df: DataFrame, when: Column, severity: str, code: str, page: Column | None = None, detail: Column | None = None) -> DataFrame:
    """A check for each row that a condition holds for."""
    nothing = F.lit(None).cast("string")
    return df.filter(when).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (page if page is not None else F.lit(0)).cast("long").alias("page"), (detail.cast("string") if detail is not None else nothing).alias("detail"))


def document_shape(before: DataFrame, now: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Tables (page, width, height): pages that were added, that are gone, whose size differs."""
    b, n = before.select("page", F.col("width").alias("w0"), F.col("height").alias("h0")), now.select(F.col("page").alias("page1"), F.col("width").alias("w1"), F.col("height").alias("h1"))
    both = b.join(n, b["page"] == n["page1"], "full_outer").withColumn("p", F.coalesce("page", "page1"))
    other = (F.abs(F.col("w0") - F.col("w1")) > tolerance) | (F.abs(F.col("h0") - F.col("h1")) > tolerance)
    return found(both, F.col("page").isNull(), "warning", "pages_added", F.col("p")).unionAll(found(both, F.col("page1").isNull(), "blocker", "pages_removed", F.col("p"))).unionAll(found(both, other, "blocker", "size_mismatch", F.col("p")))


def moved_content(regions: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(page, top, removed): pages from which much ink is gone, with the topmost place.

    A sum of doubles depends on the order in which they are added, so a page at the very limit may fall on either side by
    how rows came to lie in tasks. With `order`, columns that no two rows of a page share, a page's rows are added one
    after the other in that order: they stream through one task, with as many tasks as the rows ask for."""
    gone, top = F.sum("removed"), F.min(F.when(F.col("removed") > 0, F.col("top")))
    if order:
        w = Window.partitionBy("page").orderBy(*order)
        up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        dealt = regions.repartition(parts_for(regions.sparkSession, regions.count()), "page")
        per = dealt.select("page", gone.over(up_to).alias("removed"), top.over(up_to).alias("top"), F.lead(F.lit(True)).over(w).isNull().alias("last")).filter("last")
    else:
        per = regions.groupBy("page").agg(gone.alias("removed"), top.alias("top"))
    return found(per, F.col("removed") >= MOVED, "blocker", "reflow", F.col("page"), F.round("top", 3))


def margins(regions: DataFrame, margin: float, width: float, height: float) -> DataFrame:
    """(page, x0, y0, x1, y1): pages with something nearer to the edge than the margin; 0 or less asks nothing."""
    near = F.least("x0", "y0", width - F.col("x1"), height - F.col("y1"))
    worst = regions.groupBy("page").agg(F.min(near).alias("nearest"))
    return found(worst, (F.col("nearest") < margin) & F.lit(margin > 0), "warning", "margin", F.col("page"), F.round("nearest", 3))


def legibility(regions: DataFrame) -> DataFrame:
    """(page, dark): pages where a region lies on mostly dark ground; the darkest is told."""
    worst = regions.groupBy("page").agg(F.max("dark").alias("dark"))
    return found(worst, F.col("dark") >= DARK, "warning", "legibility", F.col("page"), F.round("dark", 3))


def slack(regions: DataFrame) -> DataFrame:
    """(page, clearance): pages with less room than registration needs."""
    tightest = regions.groupBy("page").agg(F.min("clearance").alias("clearance"))
    return found(tightest, F.col("clearance") < SLACK, "note", "slack", F.col("page"), F.round("clearance", 3))


def coverage(pages: DataFrame) -> DataFrame:
    """(page, share): pages of which much is covered."""
    return found(pages, F.col("share") >= MUCH, "warning", "large_delta", F.col("page"), F.round("share", 4))


def emptiness(pages: DataFrame) -> DataFrame:
    """(page, added, removed): nothing at all is new; or nothing is new and much is gone, as if inputs were swapped."""
    total = pages.agg(F.coalesce(F.sum("added"), F.lit(0.0)).alias("added"), F.coalesce(F.sum("removed"), F.lit(0.0)).alias("removed"))
    return found(total, (F.col("added") == 0) & (F.col("removed") == 0), "blocker", "empty_delta").unionAll(found(total, (F.col("added") == 0) & (F.col("removed") > 0), "blocker", "documents_reversed"))


def calibration(jobs: DataFrame) -> DataFrame:
    """(page, profile, paper, profile_paper): jobs without a profile, or with one for other paper."""
    return found(jobs, F.col("profile").isNull(), "note", "not_calibrated", F.col("page")).unionAll(found(jobs, F.col("profile").isNotNull() & (F.col("paper") != F.col("profile_paper")), "warning", "other_paper", F.col("page")))


def placements(lines: DataFrame, margin: float, width: float, height: float) -> DataFrame:
    """(page, x, y): lines off the page, or near its edge."""
    off = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") > width) | (F.col("y") > height)
    near = F.least("x", "y", width - F.col("x"), height - F.col("y")) < margin
    return found(lines, off, "blocker", "off_page", F.col("page")).unionAll(found(lines, ~off & near, "warning", "near_edge", F.col("page")))


def gathered(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def without_symptoms(checks: DataFrame) -> DataFrame:
    """Where inputs were swapped, what follows from that is left out: moved content. Coverage warnings stay."""
    swapped = checks.agg(F.coalesce(F.bool_or(F.col("code") == "documents_reversed"), F.lit(False)).alias("swapped"))
    return checks.crossJoin(swapped).filter(~(F.col("swapped") & F.col("code").isin("reflow", "heavy_coverage"))).drop("swapped")  # one row


def verdict(checks: DataFrame) -> DataFrame:
    """One row: whether a blocker is there, and whether no blocker is anything but moved content."""
    blocker = F.col("severity") == "blocker"
    return checks.agg(F.coalesce(F.bool_or(blocker), F.lit(False)).alias("blocked"), F.coalesce(F.bool_and(F.when(blocker, F.col("code") == "reflow")), F.lit(True)).alias("only_moved"))


def softened(checks: DataFrame) -> DataFrame:
    """Blockers of moved content as one warning, once the moved pages are printed anew."""
    moved = checks.filter("code = 'reflow' AND severity = 'blocker'")
    one = moved.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("warning").alias("severity"), F.lit("reprinted").alias("code"), F.lit(0).cast("long").alias("page"), F.col("n").cast("string").alias("detail"))
    return checks.filter("NOT (code = 'reflow' AND severity = 'blocker')").unionByName(one)


def severity_order(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
