"""Nearest neighbours, margins, ranked and ordered results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.measure import shares
from tallyframe.operators import scan
from tallyframe.operators.tables import forget, written

#: The farthest that still is the same document, the lead a match must have, the least density of a page.
SAME, LEAD, DENSITY = 0.30, 0.12, 0.0005

#: Vectors that are compared at a time, about: candidates, and sheets. Blocks of candidates that one task goes through, and
#: the tasks that share the candidates at least.
BLOCK, CHUNK = 2048, 512
BLOCKS, SPLIT = 64, 4


def ranked_candidates(sheets: DataFrame, candidates: DataFrame, keep: int) -> DataFrame:
    """(sheet, candidate, distance, rank): the `keep` candidates nearest to each sheet by half the sum of differences
    of shares; vectors that can't be compared come last.

    Both tables are (id, v). Every sheet is compared with every candidate, as the result asks, which is quadratic where both
    are one table; vectors travel as blocks, so a task holds a pair of blocks and not a table. A task goes through many
    blocks of candidates and keeps the nearest ones of a sheet only, so what is merged grows with the sheets.
    """
    size = len((candidates.select("v").first() or [[]])[0])
    n_blocks, n_chunks = (max(1, -(-df.count() // most)) for df, most in ((candidates, BLOCK), (sheets, CHUNK)))
    missing = F.array_repeat(F.lit(float("nan")), size)

    def stacked(df: DataFrame, n: int, parts: int, number: str, ids: str, matrix: str) -> DataFrame:
        """Vectors in `n` rows, by a hash of their ids, dealt out evenly."""
        placed = df.select(F.col("id").cast("long").alias("id"), F.coalesce(shares(F.col("v")), missing).alias("v"))
        rows = placed.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(number)).agg(F.collect_list("id").alias(ids), F.flatten(F.collect_list("v")).alias(matrix))
        return rows.repartition(parts)

    blocks = stacked(candidates, n_blocks, min(n_blocks, max(SPLIT, -(-n_blocks // BLOCKS))), "block", "candidates", "m")
    chunks = stacked(sheets, n_chunks, n_chunks, "chunk", "sheets", "q")

    def compare(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for i in range(len(batch)):
                # Views of the batch, one pair of blocks at a time, not lists of Python numbers.
                asked, ids = (batch.column(c)[i].values.to_numpy() for c in ("sheets", "candidates"))
                q, m = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("q", "m"))
                found = nearest(q.reshape(len(asked), -1), m.reshape(len(ids), -1), ids, keep)
                chunk = batch.column("chunk")[i].as_py()
                if chunk in held:
                    was = held[chunk][1:]
                    found = first_of(*(np.concatenate(both) for both in zip(was, found, strict=True)), keep)
                held[chunk] = (np.array(asked), *found)
        for asked, s, c, d in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(asked[s]), pa.array(c), pa.array(d)], names=["sheet", "candidate", "distance"])

    schema = T.StructType([T.StructField("sheet", T.LongType()), T.StructField("candidate", T.LongType()), T.StructField("distance", T.DoubleType())])
    pairs = chunks.crossJoin(blocks).mapInArrow(compare, schema)  # all against all, in blocks
    w = Window.partitionBy("sheet").orderBy("distance", "candidate")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def first_of(s: np.ndarray, c: np.ndarray, d: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `keep` candidates `c` of each sheet `s` by distance `d`, then by id."""
    order = np.lexsort((c, d, s))
    s, c, d = s[order], c[order], d[order]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    return s[place < keep], c[place < keep], d[place < keep]


def nearest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the sheet, id of the candidate, distance): for each row of `a`, the `keep` rows of `b` nearest to it.

    Half the differences of shares are 1 less what both have in common. That is added up in single precision for all
    pairs, and only pairs that its error leaves among the nearest are told apart by their differences in doubles."""
    n = b.shape[1]
    largest = max(1.0, *(np.nan_to_num(np.abs(x).sum(axis=1)).max() for x in (a, b)))  # over 1 where elements are negative
    slack = 4 * (n + 4) * np.finfo(np.float32).eps * largest
    a_, b_, ones = a.astype(np.float32), b.astype(np.float32), np.ones(n, np.float32)
    least, common = np.empty_like(b_), np.empty((CHUNK // 16, len(b)), np.float32)
    parts = []
    for start in range(0, len(a), len(common)):
        rows = a_[start : start + len(common)]
        got = common[: len(rows)]
        for row, out in zip(rows, got, strict=True):
            np.minimum(b_, row, out=least)
            np.dot(least, ones, out=out)
        got[np.isnan(got)] = -np.inf
        edge = np.partition(got, len(b) - keep, axis=1)[:, len(b) - keep] if keep < len(b) else np.full(len(rows), -np.inf)
        s, c = np.nonzero(got >= (edge - slack)[:, None])
        d = np.abs(b[c] - a[start + s]).sum(axis=1) / 2
        parts.append(first_of(start + s, ids[c], np.where(np.isnan(d), np.inf, d), keep))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def confident(ranked: DataFrame, by: str, distance: str, density: Column | None = None) -> DataFrame:
    """(by, candidate, best, second, sure): whether the nearest is near enough and far enough ahead of the next; a
    single candidate needs no lead; nearly blank sheets are never sure."""
    g = ranked.groupBy(by).agg(F.max(F.when(F.col("rank") == 1, F.col(distance))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col(distance))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("candidate"))).alias("candidate"))
    sure = (F.col("best") <= SAME) & F.coalesce(F.col("second") - F.col("best") >= LEAD, F.lit(True))
    return g.withColumn("sure", sure if density is None else sure & (density > DENSITY))


def near_ties(df: DataFrame, by: list[str], order: str, score: str, name: str, within: float = 0.02) -> DataFrame:
    """(by, name): of each group's rows in order of preference, the name that stays when a later one must be better by over
    the given share of the score held. Scores are over 0; rows without one don't count.

    Only rows over all before them are ever held, and what a held one is left for is the least of those over its bound.
    That is found for all at once by a scan downwards over scores and bounds; then pointers are followed twice as far in
    each round, so rounds grow with the logarithm of the logarithm of the range of scores."""
    group, s = F.struct(*by).alias("g"), F.col("s")
    rows = df.select(group, F.col(order).alias("o"), F.col(score).cast("double").alias("s"), F.col(name).alias("name")).filter(s > 0)
    held = scan.before(scan.dealt(rows, ["g"], ["o"], "ordered"), ["g"], most=("max", s))
    records = written(held.filter(F.col("most").isNull() | (s > F.col("most"))).select("g", "s", "name"), "records")
    both = records.select("g", (-s).alias("down"), F.lit(1).alias("kind"), "s").unionByName(records.select("g", (-s * (1 + within)).alias("down"), F.lit(0).alias("kind"), "s"))
    seen = scan.before(scan.dealt(both, ["g"], ["down", "kind"], "bounds"), ["g"], to=("last", F.when(F.col("kind") == 1, s)))
    step = written(seen.filter("kind = 0").select("g", "s", "to"), "steps")
    while True:
        ahead = step.select(F.col("g").alias("g_"), F.col("s").alias("s_"), F.col("to").alias("to_")).filter("to_ IS NOT NULL")
        met = step.join(ahead, F.col("g").eqNullSafe(F.col("g_")) & (F.col("to") == F.col("s_")), "left")
        moved = written(met.select("g", "s", F.coalesce("to_", "to").alias("to"), F.col("to_").isNotNull().alias("moved")), "steps", F.col("moved"))
        forget(step)
        step = moved.drop("moved")
        step.written_to = moved.written_to
        if not moved.any:
            break
    first = step.groupBy("g").agg(F.min_by(F.coalesce("to", "s"), "s").alias("last"))
    end = first.select(F.col("g").alias("g_"), "last").join(records, F.col("g").eqNullSafe(F.col("g_")) & (F.col("last") == s))
    return end.select(*[F.col(f"g.`{c}`").alias(c) for c in by], F.col("name").alias(name))


def near_tie(ordered: Column, within: float = 0.02) -> Column:
    """`near_ties` of a short list of (score, name), in one value."""
    start = F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("name"))

    def step(held: Column, x: Column) -> Column:
        better = held["score"].isNull() | (x["score"] > held["score"] * (1 + within))
        return F.when(better, F.struct(x["score"].cast("double").alias("score"), x["name"].alias("name"))).otherwise(held)

    return F.aggregate(ordered, start, step)["name"]


def top(df: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first `keep` rows of each group, with their `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= keep)
