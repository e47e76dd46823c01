"""Mix sources to target weights: whole copies by the whole part of a source's rate, one more by the fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import common
from tallyframe.llm.common import WORD
from tallyframe.operators import sequence

#: Weights of the sources in their order, repeating, and the most that a source may be repeated.
WEIGHTS, MOST = (5, 2, 1), 3.0

#: Steps in which the draws of a source are counted, and how many of them are summed together first.
STEPS, TOGETHER = 1 << 14, 1 << 7


def words_in(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, size) -> (source, source_size, target): a share of all sizes by weight, `most` times its size at most.

    Sources come in the order of their code points (Spark compares UTF-8 bytes, which is the same), null last, and
    take the weights in turn. What a source can't take is shared again by weight among the others until none is
    above its bound: each round sums, over the table of sources, what those take whose bound lies below the share for
    each unit of weight, and raises the share of the rest. A round brings two sums to the driver, and rounds end when
    no further source is at its bound. Numbering and sums are distributed, however many sources there are.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    place = ((F.col("number") - 1) % len(weights)).cast("int")
    per = sequence.numbered(per, "none", "source").withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[place])
    per = per.select("source", "source_size", "weight", (most * F.col("source_size")).alias("bound"))
    per = common.written(per.withColumn("ratio", F.col("bound") / F.col("weight")), "sources")
    whole = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"), F.count("*").alias("n")).first()
    level, free = (whole["size"] / whole["weight"], whole["n"]) if whole["n"] else (0.0, 0)
    while True:
        open_ = F.col("ratio") >= level
        got = per.agg(F.sum(F.when(~open_, F.col("bound"))).alias("taken"), F.sum(F.when(open_, F.col("weight"))).alias("weight"), F.count_if(open_).alias("free")).first()
        if got["free"] == free or not got["free"]:
            break
        level, free = (whole["size"] - (got["taken"] or 0.0)) / got["weight"], got["free"]
    return per.select("source", "source_size", F.least(F.col("bound"), F.col("weight") * level).alias("target"))


def draw(seed: int, *cols: Column) -> Column:
    """A number from 0 up to 1 from the columns' text: the first 52 bits of an MD5 digest."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def step(seed: int, id_: Column) -> Column:
    return F.floor(draw(seed, id_) * STEPS)


def plan(sizes: DataFrame, seed: int, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(id, source, size) -> (source, source_size, target, whole, fraction, low, high, some, all): each document of a source
    is taken `whole` times, and once more if the step of its draw lies from `low` up to `high`, going round.

    Systematic sampling: a source's words lie on a circle, in steps by the draws of their documents. From a point drawn for the
    source on, as many words are taken as the fraction comes to: a step's documents are, if the step begins there. As
    each point is as likely as any other, each document is taken with the fraction's probability, whatever its size; and
    the words taken miss the fraction's by one step's at most, that is by one document's where a step holds one.
    """
    bins = sizes.select("source", "size", step(seed, F.col("id")).alias("step")).groupBy("source", "step").agg(F.sum("size").alias("size"))
    bins = common.written(bins, "draws")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(bins.select("source", "size"), weights, most).withColumn("whole", F.floor(rate)).withColumn("fraction", rate - F.floor(rate))
    targets = targets.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("from", draw(seed, F.lit("of"), F.col("source")) * F.col("source_size"))
    targets = common.written(targets, "targets")  # a row for each source, of a size that Spark then knows
    # Words before each step: those of the steps before among its 128, and of the groups of 128 before; no window is longer.
    fine = bins.filter("size > 0").withColumn("group", F.floor(F.col("step") / TOGETHER))
    before = F.sum("size").over(Window.partitionBy("source", "group").orderBy("step")) - F.col("size")
    coarse = fine.groupBy("source", "group").agg(F.sum("size").alias("size"))
    coarse = coarse.select(F.col("source").alias("of"), F.col("group").alias("og"), (F.sum("size").over(Window.partitionBy("source").orderBy("group")) - F.col("size")).alias("earlier"))
    each = fine.withColumn("before", before).join(coarse, F.col("source").eqNullSafe(F.col("of")) & (F.col("group") == F.col("og"))).select("source", "step", (F.col("before") + F.col("earlier")).alias("start"))
    each = each.join(targets.select(F.col("source").alias("of"), "source_size", "wanted", "from"), F.col("source").eqNullSafe(F.col("of")))
    off = F.col("start") - F.col("from") + F.when(F.col("start") < F.col("from"), F.col("source_size")).otherwise(0)
    inside = F.col("off") < F.col("wanted")
    ends = each.withColumn("off", off).groupBy(F.col("source").alias("of")).agg(
        F.min_by("step", F.when(inside, F.col("off"))).alias("low"), F.min_by("step", F.when(~inside, F.col("off"))).alias("high"), F.max(inside).alias("some"), F.min(inside).alias("all")
    )
    return targets.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "whole", "fraction", "low", "high", "some", "all")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, keep: list[str] | None = None, independent: bool = False) -> DataFrame:
    """Each document once, with `size`, `source_size`, `target`, `fraction` (all three of its source) and `copies`.

    copies is the whole part of target / source_size, and one more with the fraction's probability, by numbers drawn
    from the seed and the id and from the seed and the source (`plan`); reruns agree, and it is never over `most`. Null
    texts and texts without words have size 0; null is a source like any other; rows with the same id share the draw and
    so the copies; ids whose draws meet in a step are taken together; sources of size 0 have target 0 and no copies; no
    rows give no rows. Columns called like a result are replaced, others pass (or only those in `keep`).

    Sums by source and step are combined before their shuffle. The join with the plan carries no hot key's rows to one
    task: Spark broadcasts the table of sources when its measured size is under spark.sql.autoBroadcastJoinThreshold,
    and else splits skewed partitions of its sort-merge join.
    """
    own = {"size", "source_size", "target", "fraction", "copies"}
    kept = [c for c in docs.columns if c.lower() not in own] if keep is None else keep
    base = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), words_in(F.col(f"`{text_col}`")).alias("size")]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], *base)
    plans = common.written(plan(docs.select(*base), seed), "plan").withColumnRenamed("source", "of")
    mixed = inner.join(plans, F.col("source").eqNullSafe(F.col("of")), "left")
    at, low, high = step(seed, F.col("id")), F.col("low"), F.col("high")
    more = F.when(~F.coalesce("some", F.lit(False)), False).when(F.col("all"), True).when(low < high, (at >= low) & (at < high)).otherwise((at >= low) | (at < high))
    if independent:
        more = draw(seed, F.col("id")) < F.col("fraction")
    copies = F.col("whole") + more.cast("int")
    return mixed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target", "fraction", copies.cast("long").alias("copies"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: int | bool) -> DataFrame:
    """The mixture itself: the documents, each as often as `mix` says, with their own columns only."""
    safe, at = common.by_place(docs)
    mixed = mix(safe, at[id_col], at[text_col], at[source_col], **how)
    # Whole copies are made by an array of that length; there are `MOST` of them at most.
    out = mixed.filter("copies > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(n).alias(c) for c, n in at.items()])
