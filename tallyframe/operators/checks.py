"""All checks of many jobs at once: rows (job, severity, code, page, detail); page 0 stands for the whole job.

A job compares a document as it was printed with its edit. Tables: `before` and `now` (job, page, width, height), pages
counted from 1; `added` (job, page, x0, y0, x1, y1, ink) and `removed` (job, page, y0, ink), what is new on a page and what
is gone from it; `jobs` (job, profile), every job once, its profile null where it has none. A page is once in `before` and
in `now`. Everything is added up by page first, in as many tasks as the rows ask for, and a job's pages then, of which it
may have any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import scan
from tallyframe.operators.rules import MOVED, MUCH, gathered, severity_order
from tallyframe.operators.tables import forget, parts_for, written

#: Sizes that differ by no more are the same (mm).
SAME_SIZE = 0.5


def said(df: DataFrame, severity: str, code: str, page: Column | None = None, detail: Column | None = None) -> DataFrame:
    """A check for each row."""
    number = detail.cast("double") if detail is not None else F.lit(None).cast("double")
    return df.select("job", F.lit(severity).alias("severity"), F.lit(code).alias("code"), (page if page is not None else F.lit(0)).cast("long").alias("page"), number.alias("detail"))


#: What a row of `facts` tells of a page.
BEFORE, NOW, ADDED, REMOVED = range(4)


def facts(before: DataFrame | None = None, now: DataFrame | None = None, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """(job, page, kind, a, b, c, ink): sizes before and now, what is new (its least place, its far ends negated), what is gone."""
    nothing = F.lit(None).cast("double")

    def told(df: DataFrame, kind: int, a: Column, b: Column = nothing, c: Column = nothing, ink: Column = nothing) -> DataFrame:
        return df.select("job", "page", F.lit(kind).alias("kind"), *[x.cast("double").alias(n) for n, x in {"a": a, "b": b, "c": c, "ink": ink}.items()])

    parts = [told(df, kind, F.col("width"), F.col("height")) for df, kind in ((before, BEFORE), (now, NOW)) if df is not None]
    if added is not None:
        parts.append(told(added, ADDED, F.least("x0", "y0"), -F.col("x1"), -F.col("y1"), F.col("ink")))
    if removed is not None:
        parts.append(told(removed, REMOVED, F.col("y0"), ink=F.col("ink")))
    return gathered(parts)


def by_page(facts: DataFrame, margin: float) -> DataFrame:
    """One row for each page: what it adds to its job (`side`, `new`, `gone`, `edited`), and the details of the checks that it
    gives rise to, null where it gives none. `other`: a page of both with another size; `top`: much ink is gone, the
    topmost place; `near`: additions nearer to an edge than the margin (0 or less asks nothing), how near; `share`: much is
    covered by what is new. Rows meet in tasks of bounded rows; those of one page stream through one task."""
    kind, no = F.col("kind"), lambda k: F.count_if(F.col("kind") == k)
    of = lambda k, c: F.when(kind == k, F.col(c))
    size = lambda c: F.when(kind <= NOW, F.col(c))
    pages = facts.repartition(parts_for(facts.sparkSession, facts.count()), "job", "page").groupBy("job", "page").agg(
        *[no(k).alias(n) for k, n in enumerate(("before", "now", "added", "removed"))],
        *[(F.max(size(c)) - F.min(size(c))).alias(n) for n, c in (("wider", "a"), ("taller", "b"))],
        *[F.max(of(BEFORE, c)).alias(n) for n, c in (("width", "a"), ("height", "b"))],
        *[F.min(of(ADDED, c)).alias(n) for n, c in (("least", "a"), ("right", "b"), ("bottom", "c"))],
        F.sum(of(ADDED, "ink")).alias("ink"), F.sum(of(REMOVED, "ink")).alias("gone"), F.min(of(REMOVED, "a")).alias("top"),
    )
    sized = (F.col("before") > 0) & (F.col("added") > 0) & F.col("job").isNotNull() & F.col("page").isNotNull()
    near = F.least("least", F.col("width") + F.col("right"), F.col("height") + F.col("bottom"))
    area = F.col("width") * F.col("height")
    return pages.select(
        "job", F.col("page").cast("long").alias("page"), (F.col("now") - F.col("before")).alias("side"), (F.col("added") > 0).alias("new"), "gone", (F.col("added") + F.col("removed") > 0).alias("edited"),
        F.when((F.col("before") + F.col("now") > 1) & ((F.col("wider") > SAME_SIZE) | (F.col("taller") > SAME_SIZE)), F.greatest("wider", "taller")).alias("other"),
        F.when(F.col("gone") >= MOVED, F.coalesce("top", F.lit(0.0))).alias("top"),
        F.when(sized & (near < margin) & F.lit(margin > 0), F.greatest(near, F.lit(0.0))).alias("near"),
        F.when(sized & (area > 0) & (F.col("ink") > 0) & (F.col("ink") >= MUCH * area), F.col("ink") / area).alias("share"),
    )


#: Checks of single pages: severity, code and the column of `by_page` that has the detail.
OF_PAGES = (("blocker", "page_size_mismatch", "other"), ("blocker", "reflow", "top"), ("warning", "margin", "near"), ("warning", "large_delta", "share"))


def of_pages(pages: DataFrame) -> DataFrame:
    each = F.array(*[F.when(F.col(detail).isNotNull(), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("page"), F.col(detail).alias("detail"))) for severity, code, detail in OF_PAGES])
    return pages.select("job", F.inline(F.filter(each, lambda c: c.isNotNull())))


def of_jobs(jobs: DataFrame, pages: DataFrame) -> list[DataFrame]:
    """Pages that the edit has more or fewer, in number. Jobs without additions: with something gone, as if the documents
    were swapped, or with nothing at all."""
    listed = jobs.select("job", F.lit(0).cast("long").alias("side"), F.lit(False).alias("new"), F.lit(0.0).alias("gone"), F.lit(True).alias("edited"))
    each = pages.select("job", "side", "new", "gone", "edited").unionByName(listed)
    n = each.repartition(parts_for(jobs.sparkSession, each.count()), "job").groupBy("job").agg(F.sum("side").alias("more"), F.bool_or("new").alias("new"), F.coalesce(F.sum("gone"), F.lit(0.0)).alias("gone"), F.bool_or("edited").alias("edited"))
    nothing, gone, more = F.lit(None).cast("double"), F.col("gone"), F.col("more")
    check = lambda when, severity, code, detail: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(0).cast("long").alias("page"), detail.cast("double").alias("detail")))
    empty = F.col("edited") & ~F.col("new")
    every = F.array(check(more > 0, "warning", "pages_added", more), check(more < 0, "blocker", "pages_removed", -more), check(empty & (gone > 0), "blocker", "documents_reversed", gone), check(empty & (gone <= 0), "blocker", "empty_delta", nothing))
    return [n.select("job", F.inline(F.filter(every, lambda c: c.isNotNull())))]


def margins(added: DataFrame, before: DataFrame, margin: float) -> DataFrame:
    """Pages with additions nearer to an edge than the margin, and how near the nearest is; 0 or less asks nothing."""
    return of_pages(by_page(facts(before=before, added=added), margin)).filter("code = 'margin'")


def calibration(jobs: DataFrame) -> list[DataFrame]:
    """Whether a job has a profile."""
    return [said(jobs.filter("profile IS NOT NULL"), "note", "calibrated"), said(jobs.filter("profile IS NULL"), "note", "uncalibrated")]


def everything(jobs: DataFrame, before: DataFrame, now: DataFrame, added: DataFrame, removed: DataFrame, margin: float = 5.0) -> DataFrame:
    """Every check of every job, as a table."""
    pages = written(by_page(facts(before, now, added, removed), margin), "pages")
    found = written(gathered([of_pages(pages), *of_jobs(jobs, pages), *calibration(jobs)]), "checks")
    forget(pages)
    return found


def to_read(checks: DataFrame) -> DataFrame:
    """Add `place` in a job, from 1: worst first, then by page, then by code."""
    keyed = checks.withColumn("__severity", severity_order(F.col("severity")))
    return scan.placed(keyed, ["job"], ["__severity", "page", "code"]).drop("__severity")


def by_job(df: DataFrame) -> DataFrame:
    """Rows dealt out by job, to tasks of bounded rows."""
    return df.repartition(parts_for(df.sparkSession, df.count()), "job")


def without_symptoms(checks: DataFrame) -> DataFrame:
    """Where documents were swapped, moved content is left out: it follows from that. Coverage warnings stay."""
    follows, swapped = F.col("code").isin("reflow", "heavy_coverage"), F.col("code") == "documents_reversed"
    n = parts_for(checks.sparkSession, checks.count())
    some = checks.filter(swapped).select("job").repartition(n, "job").distinct()
    return checks.filter(~follows).unionByName(checks.filter(follows).repartition(n, "job").join(some, "job", "left_anti").select(*checks.columns))


def verdicts(jobs: DataFrame, checks: DataFrame) -> DataFrame:
    """(job, blocked, only_moved): whether a blocker is there, and whether no blocker is anything but moved content."""
    other = checks.filter("severity = 'blocker' AND job IS NOT NULL").select("job", (F.col("code") != "reflow").alias("other"), F.lit(False).alias("listed"))
    each = by_job(jobs.select("job", F.lit(None).cast("boolean").alias("other"), F.lit(True).alias("listed")).unionByName(other))
    told = each.groupBy("job").agg(F.bool_or("other").alias("other"), F.bool_or("listed").alias("listed")).filter("listed")
    return told.select("job", F.col("other").isNotNull().alias("blocked"), (~F.coalesce("other", F.lit(False))).alias("only_moved"))


def split(checks: DataFrame) -> DataFrame:
    """Moved pages as one warning for each job, with their number: once these are printed anew, nothing stands in the way."""
    one = by_job(checks.filter("code = 'reflow'").select("job")).groupBy("job").agg(F.count("*").alias("n"))
    return checks.filter("code <> 'reflow'").unionByName(said(one, "warning", "reflow_split", None, F.col("n")))
