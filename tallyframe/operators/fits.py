"""Statistics and fits: medians by index, lines, trimmed lines, similarities, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.tables import forget, written


#: Values of a group that may be put in order, and the bins in which more of them are counted to leave fewer.
MOST, BINS = 20_000, 4_096


def bin_of(x: Column, low: Column, high: Column, by_size: Column, exact: bool) -> Column:
    """Which of BINS bins between low < high, which rises with x and differs for low and high: of equal width, or, where
    `by_size` holds, of equal ratio, below zero and above."""
    last = F.lit(BINS - 1).cast("long")
    if exact:
        d = lambda c: c.cast("decimal(20,0)")
        return F.least(F.floor((d(x) - d(low)) * BINS / (d(high) - d(low))).cast("long"), last)
    span, inf = high - low, F.lit(float("inf"))
    # The widest ranges of doubles have no width that is a double; half of it is.
    width = F.when(span < inf, (x - low) / F.when(span < inf, span).otherwise(1.0)).otherwise((x / 2 - low / 2) / F.when(span < inf, 1.0).otherwise(high / 2 - low / 2))
    size = lambda c: F.when(c > 0, F.ln(F.when(c > 0, c).otherwise(1.0)) + 746).when(c < 0, -(F.ln(F.when(c < 0, -c).otherwise(1.0)) + 746)).otherwise(0.0)  # noqa: E731  # over 0 from the smallest double up
    ratios = size(high) - size(low)
    place = F.when(by_size & (ratios > 0), (size(x) - size(low)) / F.when(ratios > 0, ratios).otherwise(1.0)).otherwise(width)
    return F.least(F.floor(place * BINS), last)


def elements(df: DataFrame, by: list[str], x: str, at: dict[str, Column]) -> DataFrame:
    """(by, n, one column for each of `at`): elements of each group's sorted values, nulls left out, by index from 0. `at`
    gives the index as an expression of `n`; null where there is no such element. Infinities come first and last, NaN after
    them.

    No group of over `MOST` values is sorted: values between the bounds known so far are counted in bins, and the bin that
    holds the element gives closer bounds, again and again, until few values, or one, lie between. Bins have equal widths;
    after a round that has left most values in one bin they have equal ratios once, so that some far values cost two
    rounds. Bounds get closer in every round: from the widest range of doubles it takes some ten. Infinities and NaN are
    counted, not put in bins. The last values are put in order, each distinct one once.
    """
    names = list(at)
    # Columns of our own, which no group column is called like.
    x_, no, i, low, high, held, below, by_size = (F.col(f"__{c}") for c in ("x", "no", "i", "low", "high", "held", "below", "by_size"))
    wide = (held > MOST) & (low < high)
    kind = df.schema[x].dataType
    exact = not isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))
    rows = df.select(*by, (F.col(x).cast("double") if isinstance(kind, T.DecimalType) else F.col(x)).alias("__x")).filter("__x IS NOT NULL")
    inf, minus = F.lit(float("inf")), F.lit(float("-inf"))
    finite = F.lit(True) if exact else (x_ > minus) & (x_ < inf)
    of_finite = lambda fold: fold(F.when(finite, x_))
    counts = written(rows.groupBy(*by).agg(F.count("*").alias("n"), of_finite(F.min).alias("__low"), of_finite(F.max).alias("__high"), F.count_if(F.lit(False) if exact else x_ == minus).alias("__first"), F.count_if(finite).alias("__held"), F.count_if(F.lit(False) if exact else x_ == inf).alias("__last")), "counts", wide)
    index = F.explode(F.array(*[F.struct(F.lit(k).alias("__no"), (at[c].cast("long") - F.col("__first")).alias("__i")) for k, c in enumerate(names)]))
    bounds = counts.withColumn("__e", index).filter("__e.__i BETWEEN 0 AND __held - 1")
    bounds = bounds.select(*by, "__e.__no", "__e.__i", "__low", "__high", "__held", F.lit(0).cast("long").alias("__below"), F.lit(False).alias("__by_size"))
    between = lambda found: rows.filter(finite).join(found, by).filter((x_ >= low) & (x_ <= high))
    last = counts
    while last.any:
        keys = [*by, "__no", "__i", "__below", "__by_size"]
        binned = between(bounds.filter(wide).withColumnRenamed("__held", "__of")).groupBy(*keys, "__of", bin_of(x_, low, high, by_size, exact).alias("__bin")).agg(F.count("*").alias("__held"), F.min(x_).alias("__low"), F.max(x_).alias("__high"))
        up_to = below + F.sum("__held").over(Window.partitionBy(*by, "__no").orderBy("__bin"))
        chosen = binned.withColumn("__up_to", up_to).filter((F.col("__up_to") > i) & (F.col("__up_to") - held <= i))
        closer = chosen.select(*by, "__no", "__i", "__low", "__high", "__held", (F.col("__up_to") - held).alias("__below"), (~by_size & (held * 4 > F.col("__of"))).alias("__by_size"))
        bounds = written(bounds.filter(~wide).unionByName(closer), "bounds", wide)
        if last is not counts:
            forget(last)
        last = bounds
    # Elements that lie between the same bounds are looked for together: each row is read once for all of them.
    ends = [*by, "__low", "__high", "__below"]
    sought = [f"__i{k}" for k in range(len(names))]
    together = bounds.groupBy(*ends).agg(*[F.max(F.when(no == k, i)).alias(c) for k, c in enumerate(sought)])
    tally = between(together).groupBy(*ends, *sought, "__x").agg(F.count("*").alias("__held"))
    ranked = tally.withColumn("__up_to", below + F.sum("__held").over(Window.partitionBy(*ends).orderBy("__x")))
    found = ranked.groupBy(*by).agg(*[F.min(F.when(F.col("__up_to") > F.col(c), x_)).alias(f"__found{k}") for k, c in enumerate(sought)])
    out = counts.withColumnRenamed("__held", "__finite").join(found, by, "left")
    value = lambda k, at_: F.col(f"__found{k}") if exact else F.when((at_ < 0) | (at_ >= F.col("n")), None).when(at_ < F.col("__first"), minus).when(at_ < F.col("__first") + F.col("__finite"), F.col(f"__found{k}")).when(at_ < F.col("__first") + F.col("__finite") + F.col("__last"), inf).otherwise(float("nan"))
    return out.select(*by, "n", *[value(k, at[c].cast("long")).cast(kind).alias(c) for k, c in enumerate(names)])


def part_of(p: int, q: int) -> Column:
    """The index of the element that p/q of a group's values lie before."""
    return F.floor(F.col("n") * p / q)


def indexed_quantiles(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(n, lower, median, upper): elements of the sorted values at a quarter, a half, three quarters, by index."""
    return elements(df, by, x, {"lower": part_of(1, 4), "median": part_of(1, 2), "upper": part_of(3, 4)})


def trimmed_deviation(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, deviation): mean of |x - median| / median of each group's sorted values without the first and last tenth;
    null below 12 values. Of values that equal the last one cut off, as many count as are left."""
    cut = F.floor(F.col("n") / 10)
    ends = elements(df, by, x, {"median": part_of(1, 2), "first": cut, "last": F.col("n") - 1 - cut})
    off = lambda v: F.abs(v - F.col("median")) / F.col("median")
    v = F.col(x)
    inner = (v > F.col("first")) & (v < F.col("last"))
    got = df.filter(v.isNotNull()).join(ends, by).groupBy(*by, "n", "median", "first", "last").agg(F.sum(F.when(inner, off(v)).otherwise(0.0)).alias("inner"), F.count_if(v <= F.col("first")).alias("up_to"), F.count_if(v < F.col("last")).alias("below"))
    left = F.col("n") - 2 * cut
    total = F.when(F.col("first") == F.col("last"), left * off(F.col("first"))).otherwise(F.col("inner") + (F.col("up_to") - cut) * off(F.col("first")) + (F.col("n") - cut - F.col("below")) * off(F.col("last")))
    return got.select(*by, F.when(F.col("n") >= 12, total / left).alias("deviation"))


def line(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(n, slope, intercept) of each group's least-squares line; null below three points or where x hardly varies."""
    got = df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.sum(F.col(x) * F.col(x)).alias("xx"))
    good = (F.col("n") >= 3) & (F.col("sxx") > 1e-9 * F.col("xx"))
    return got.select(*by, "n", F.when(good, F.col("slope")).alias("slope"), F.when(good, F.col("intercept")).alias("intercept"))


def residual(x: str, y: str) -> Column:
    return F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept")))


def robust_points(df: DataFrame, by: list[str], x: str, y: str, rounds: int = 3, outlier: float = 4.0) -> DataFrame:
    """The points of a line refitted up to `rounds` times without points that miss it by over `outlier` times the upper median miss.

    Refitting a group ends when nothing is dropped, when fewer than three points would be left, or when its median
    miss is 0; its last fit stands. Points dropped once stay away. A round writes what each point misses its line by and
    reads that for the rest; what it finds is a limit for each group, a small table, and groups are not gathered.
    """
    points = df.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    for _ in range(rounds):
        lines = line(points, by, "__x", "__y").drop("n")
        miss = F.abs(F.col("__y") - (F.col("slope") * F.col("__x") + F.col("intercept")))
        judged = written(points.join(lines, by).select(*by, "__x", "__y", miss.alias("__miss")), "judged")
        median = elements(judged, by, "__miss", {"__median": part_of(1, 2)})
        limits = written(median.select(*by, F.when(F.col("__median") > 0, outlier * F.col("__median")).alias("__limit")), "limits")
        good = F.coalesce(F.col("__miss") <= F.col("__limit"), F.lit(True))
        left = judged.join(limits, by, "left").groupBy(*by).agg(F.count("*").alias("__all"), F.count_if(good).alias("__left"), F.max("__limit").alias("__limit"))
        enough = written(left.filter(F.col("__left") >= 3).select(*by, "__limit", (F.col("__left") < F.col("__all")).alias("__dropped")), "enough", F.col("__dropped"))
        points = judged.join(enough.select(*by, "__limit"), by, "left").filter(good).select(*by, "__x", "__y")
        if not enough.any:
            break
    return points.select(*by, F.col("__x").alias(x), F.col("__y").alias(y))


def robust_line(df: DataFrame, by: list[str], x: str, y: str, rounds: int = 3, outlier: float = 4.0) -> DataFrame:
    """The line through the points that `robust_points` leaves."""
    return line(robust_points(df, by, x, y, rounds, outlier), by, x, y)


def edge_angle(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Degrees an edge leans, from a line refitted once without points off by over max(3 mean misses, 2); 16 needed."""
    first = line(df, by, x, y).filter("n >= 16")
    judged = df.select(*by, x, y).join(first.drop("n"), by).withColumn("miss", residual(x, y))
    limits = judged.groupBy(*by).agg(F.greatest(3 * F.avg("miss"), F.lit(2.0)).alias("limit"))
    kept = judged.join(limits, by).filter("miss <= limit").select(*by, x, y)
    again = line(kept, by, x, y).select(*by, F.when(F.col("n") >= 16, F.col("slope")).alias("again"))
    return first.join(again, by, "left").select(*by, (-F.degrees(F.atan(F.coalesce("again", "slope")))).alias("degrees"))


def similarity(df: DataFrame, by: list[str], centre: tuple[float, float], ax: str, ay: str, bx: str, by_: str) -> DataFrame:
    """(n, dx, dy, rotation, scale, rms, worst) of the turn, scale and shift about a centre that take a to b best.

    One aggregation for the fit, one for what is left. Null where there are fewer than two points or all coincide.
    """
    re = F.covar_pop(ax, bx) + F.covar_pop(ay, by_)
    im = F.covar_pop(ax, by_) - F.covar_pop(ay, bx)
    den = F.var_pop(ax) + F.var_pop(ay)
    g = df.groupBy(*by).agg(F.count("*").alias("n"), re.alias("re"), im.alias("im"), den.alias("den"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate((ax, ay, bx, by_))])
    g = g.filter("n >= 2 AND den >= 1e-12").withColumn("a", F.col("re") / F.col("den")).withColumn("b", F.col("im") / F.col("den"))
    ux, uy = F.col("m0") - centre[0], F.col("m1") - centre[1]
    g = g.withColumn("dx", F.col("m2") - centre[0] - (F.col("a") * ux - F.col("b") * uy)).withColumn("dy", F.col("m3") - centre[1] - (F.col("b") * ux + F.col("a") * uy))
    p = df.join(g, by)
    vx, vy = F.col(ax) - centre[0], F.col(ay) - centre[1]
    miss = F.hypot(F.col("a") * vx - F.col("b") * vy + centre[0] + F.col("dx") - F.col(bx), F.col("b") * vx + F.col("a") * vy + centre[1] + F.col("dy") - F.col(by_))
    left = p.select(*by, miss.alias("miss")).groupBy(*by).agg(F.sqrt(F.avg(F.col("miss") ** 2)).alias("rms"), F.max("miss").alias("worst"))
    return g.join(left, by).select(*by, "n", "dx", "dy", F.degrees(F.atan2("b", "a")).alias("rotation"), F.hypot("a", "b").alias("scale"), "rms", "worst")


def measured(readings: DataFrame, by: list[str], centre: tuple[float, float], ax: str, ay: str, bx: str, by_: str, least: int = 3) -> DataFrame:
    """`similarity` from readings of which some are null: these are left out, and groups with fewer than `least` others."""
    good = readings.dropna(subset=[bx, by_])
    enough = good.groupBy(*by).agg(F.count("*").alias("read")).filter(F.col("read") >= least).select(*by)
    return similarity(good.join(enough, by, "left_semi"), by, centre, ax, ay, bx, by_)


def shift(df: DataFrame, by: list[str], ax: str, ay: str, bx: str, by_: str) -> DataFrame:
    """(n, dx, dy, rms, worst) of the mere shift that takes a to b best."""
    x, y = F.col(bx) - F.col(ax), F.col(by_) - F.col(ay)
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("dx"), F.avg(y).alias("dy"))
    left = df.join(g, by).select(*by, F.hypot(x - F.col("dx"), y - F.col("dy")).alias("miss"))
    return g.join(left.groupBy(*by).agg(F.sqrt(F.avg(F.col("miss") ** 2)).alias("rms"), F.max("miss").alias("worst")), by)


def minor_spread(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """The extent of points across the direction in which they spread most."""
    g = df.groupBy(*by).agg(F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"))
    angle = 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))
    p = df.join(g.select(*by, angle.alias("angle")), by)
    across = -F.col(x) * F.sin("angle") + F.col(y) * F.cos("angle")
    return p.groupBy(*by).agg((F.max(across) - F.min(across)).alias("spread"))


def histogram(df: DataFrame, level: Column, levels: int) -> DataFrame:
    """(level, n) with a row for every level."""
    spine = df.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))
    counts = df.select(level.cast("int").alias("level")).groupBy("level").agg(F.count("*").alias("n"))
    return spine.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def otsu(levels: DataFrame) -> DataFrame:
    """One row: the threshold of a histogram (level, n) that parts it best; the middle of a plateau; 128 without counts.

    The histogram has a few hundred rows, so running sums over all of them are fine.
    """
    w = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    s = levels.select("level", "n", F.sum("n").over(w).alias("w0"), F.sum(F.col("level") * F.col("n")).over(w).cast("double").alias("s0"), F.sum("n").over(everything).alias("all"), F.sum(F.col("level") * F.col("n")).over(everything).cast("double").alias("total"))
    w1 = F.col("all") - F.col("w0")
    means = F.col("s0") / F.col("w0") - (F.col("total") - F.col("s0")) / w1
    s = s.withColumn("between", F.when((F.col("w0") > 0) & (w1 > 0), F.col("w0") * w1 * means * means))
    top = F.max("between").over(everything)
    best = s.withColumn("top", top).filter(F.col("between") >= F.col("top") * (1 - 1e-12))
    return best.agg(F.coalesce(F.floor((F.min("level") + F.max("level")) / 2).cast("int"), F.lit(128)).alias("threshold"))


def histogram_share(levels: DataFrame, part: int, of: int) -> DataFrame:
    """One row: the first level up to which at least part/of of the counts lie."""
    w = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    s = levels.select("level", F.sum("n").over(w).alias("up_to"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return s.filter((F.col("up_to") * of >= F.col("all") * part) & (F.col("all") > 0)).agg(F.min("level").alias("level"))


def densest(df: DataFrame, by: list[str], x: str, width: float) -> DataFrame:
    """Mean of the values in the window of a width that holds most, from each value up; the first of equals.

    Values are counted first. Each stretch of the width is a task's own, with a copy of the next one, so a group is split
    however many values it has."""
    counted = df.groupBy(*by, F.col(x).alias("__x")).agg(F.count("*").alias("__n")).filter("__x IS NOT NULL")
    cell = F.floor(F.col("__x") / width)
    copies = F.explode(F.array(F.struct(cell.alias("c"), F.lit(True).alias("own")), F.struct((cell - 1).alias("c"), F.lit(False).alias("own"))))
    each = counted.withColumn("__e", copies).select(*by, "__x", "__n", F.col("__e.c").alias("__c"), F.col("__e.own").alias("__own"))
    frame = f"OVER (PARTITION BY {', '.join([*by, '__c'])} ORDER BY __x RANGE BETWEEN CURRENT ROW AND {width!r}D FOLLOWING)"
    found = each.select(*by, "__x", "__own", F.expr(f"sum(__n) {frame}").alias("__held"), F.expr(f"sum(__n * __x) {frame}").alias("__sum")).filter("__own")
    return found.groupBy(*by).agg(F.max_by(F.col("__sum") / F.col("__held"), F.struct("__held", -F.col("__x"))).alias("mode"), F.max("__held").alias("held"))


def leaning(points: DataFrame, by: list[str], x: str, y: str, most: float, coarse: float = 0.25, fine: float = 0.02, least: int = 200) -> DataFrame:
    """(by, degrees): the angle at which points fall into the fewest rows, found by the spread of counts of rows, first
    in coarse steps up to `most` either way, then in fine ones around the best. The first of equals; 0 below `least`.

    Each point is put down once for each angle tried, and counted by row before anything else is done.
    """
    enough = points.groupBy(*by).agg(F.count("*").alias("n"))

    def best(around: DataFrame, step: float, reach: float) -> DataFrame:
        n = round(reach / step)
        tried = around.select(*by, F.explode(F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda i: F.round(F.col("degrees") + i * step, 6))).alias("degrees"))
        p = points.select(*by, x, y).join(tried, by)
        row = F.floor(F.col(y) * F.cos(F.radians("degrees")) - F.col(x) * F.sin(F.radians("degrees")))
        rows = p.groupBy(*by, "degrees", row.alias("row")).agg(F.count("*").alias("c"))
        spread = rows.groupBy(*by, "degrees").agg(F.sum(F.col("c") * F.col("c")).alias("s"))
        return spread.groupBy(*by).agg(F.max_by("degrees", F.struct("s", -F.col("degrees"))).alias("degrees"))

    start = enough.filter(F.col("n") >= least).select(*by, F.lit(0.0).alias("degrees"))
    found = best(best(start, coarse, most), fine, coarse)
    return enough.select(*by).join(found, by, "left").select(*by, F.coalesce("degrees", F.lit(0.0)).alias("degrees"))
