"""Which of some typefaces a page is set in, by the widths of its words."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.faces import WRITABLE, width_mm
from tallyframe.operators import fits
from tallyframe.operators.tables import forget, written


def spread(df: DataFrame) -> DataFrame:
    """`df` in several tasks for each core, where few bytes make much work."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def typefaces(words: DataFrame, by: str, faces: Mapping[str, Mapping[str, int]], smallest: float = 4.0, largest: float = 200.0) -> DataFrame:
    """(by, face, size_pt, confidence, words) of each page (by, text, width in mm).

    Words of two or more letters and figures count. For each face a line is fitted, robustly, from the widths that
    words would have at 1 pt to those they have; its slope is the size, its miss over the mean width the score. The least
    score wins, of equals the face named first. Confidence compares it with the next face that would have set some
    word of the page differently. Pages without a fit, or with a size out of bounds, have no row.
    """
    names = list(faces)
    plain = words.filter(F.col("text").rlike(r"^[\p{IsAlphabetic}\p{N}]{2,}$") & ~F.col("text").rlike(f"[^{WRITABLE}]") & (F.col("width") > 0))
    set_in = F.array(*[width_mm(F.col("text"), faces[n], 1.0) for n in names])
    page = spread(written(plain.select(by, "width", set_in.alias("set_in")), "words"))
    each = page.select(by, "width", F.posexplode("set_in").alias("no", "predicted"))
    kept = written(fits.robust_points(each, [by, "no"], "predicted", "width"), "kept")
    line = fits.line(kept, [by, "no"], "predicted", "width").filter("slope IS NOT NULL")
    miss = fits.residual("predicted", "width")
    judged = kept.join(line.drop("n"), [by, "no"]).groupBy(by, "no").agg(F.count("*").alias("words"), F.first("slope").alias("size_pt"), F.round(F.sqrt(F.avg(miss * miss)) / F.avg("width"), 12).alias("score"))
    judged = written(judged, "judged")
    best = judged.groupBy(by).agg(F.min(F.struct("score", "no", "size_pt", "words")).alias("best"))
    differs = F.abs(F.col("predicted") - F.col("own")) > 1e-9 * F.greatest(F.abs("own"), F.lit(1.0))
    pairs = page.join(best, by).select(by, F.col("set_in")[F.col("best.no")].alias("own"), F.posexplode("set_in").alias("no", "predicted"))
    apart = pairs.groupBy(by, "no").agg(F.max(differs).alias("apart")).filter("apart")
    rival = judged.join(apart, [by, "no"]).groupBy(by).agg(F.min("score").alias("rival"))
    sure = F.when(F.col("rival") > 0, F.greatest(F.lit(0.0), 1 - F.col("best.score") / F.col("rival"))).otherwise(0.0)
    out = best.join(rival, by, "left").filter(F.col("best.size_pt").between(smallest, largest))
    face = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("best.no") + 1)
    return out.select(by, face.alias("face"), "best.size_pt", sure.alias("confidence"), "best.words")


#: How sure a match must be to say something of the scale, the lowest shape that does, how many matches are
#: needed, and the change of scale that is worth another pass.
SURE, LOWEST, LEAST, WORTH = 0.7, 0.05, 3, 0.02


def nearest_shape(height: Column, form: Column, shapes: list[tuple[str, float, float]]) -> Column:
    """(off, glyph, tall) of the shape (glyph, height in capitals, form) that a mark is nearest to, heights in capitals too."""
    each = F.array(*[F.struct((F.abs(height - tall) + F.abs(form - own)).alias("off"), F.lit(glyph).alias("glyph"), F.lit(tall).alias("tall")) for glyph, tall, own in shapes])
    return F.array_min(each)


def scaled_lines(marks: DataFrame, by: str, height: str, form: str, shapes: list[tuple[str, float, float]], reference: float, passes: int = 2) -> DataFrame:
    """Add `glyph`, `confidence` and `capital` to the marks of lines: the nearest shape, at the size of capitals that the
    line turns out to have.

    The first guess takes the upper quartile of heights for a tall letter, `reference` capitals high. What each sure match
    says a capital measures is the mark's height over the shape's; the upper median of that is the next pass's size, if
    LEAST marks are sure and it differs by WORTH or more; else the line is done. Sizes are a small table by line; marks
    are read again in each pass and never gathered."""
    tall = fits.elements(marks, [by], height, {"__tall": fits.part_of(3, 4)})
    sizes = written(tall.select(by, (F.col("__tall") / reference).alias("__capital"), (F.col("__tall") > 0).alias("__open")), "sizes", F.col("__open"))

    def matched() -> DataFrame:
        best = nearest_shape(F.col(height) / F.col("__capital"), F.col(form), shapes)
        rows = marks.join(sizes.filter("__capital > 0"), by).withColumn("__m", best)
        return rows.withColumn("__sure", F.exp(-F.pow(F.col("__m.off") / 0.2, 2)))

    for _ in range(passes - 1):
        if not sizes.any:
            break
        # As a table: what reads it again and again would match every mark anew for each column that it takes.
        said = written(matched().filter((F.col("__open")) & (F.col("__sure") >= SURE) & (F.col("__m.tall") > LOWEST)).select(by, (F.col(height) / F.col("__m.tall")).alias("__says")), "said")
        median = fits.elements(said, [by], "__says", {"__found": fits.part_of(1, 2)}).filter(F.col("n") >= LEAST).select(by, "__found")
        moved = F.coalesce(F.abs(F.col("__found") - F.col("__capital")) / F.col("__capital") >= WORTH, F.lit(False))
        sizes = written(sizes.join(median, by, "left").select(by, F.when(moved, F.col("__found")).otherwise(F.col("__capital")).alias("__capital"), moved.alias("__open")), "sizes", F.col("__open"))
        forget(said)
    return matched().select(*[F.col(f"`{c}`") for c in marks.columns], F.col("__m.glyph").alias("glyph"), F.col("__sure").alias("confidence"), F.col("__capital").alias("capital"))
