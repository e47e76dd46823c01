"""Differences, duplicates, changes and merges of tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.tables import written


def all_equal(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    """Null-safe equality of columns that both have."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in on])


def duplicate_groups(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows that are alike in `keys`: their numbers in order, how many, and the first. Only groups of two or more.

    Keys are replaced by a digest before the shuffle, so long texts aren't moved; equal digests of 256 bits are taken
    for equal keys. The list of numbers is the result itself; see `duplicate_counts` where groups can be very large.
    """
    if not keys:
        return df.sparkSession.createDataFrame([], f"first {dict(df.dtypes)[number]}, n long, numbers array<{dict(df.dtypes)[number]}>")
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    groups = df.select(digest.alias("key"), F.col(number).alias("number")).groupBy("key").agg(F.min("number").alias("first"), F.count("*").alias("n"), F.sort_array(F.collect_list("number")).alias("numbers"))
    return groups.filter("n > 1").select("first", "n", "numbers")


def duplicate_counts(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """As `duplicate_groups`, without the lists."""
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    return df.select(digest.alias("key"), F.col(number).alias("number")).groupBy("key").agg(F.min("number").alias("first"), F.count("*").alias("n")).filter("n > 1").select("first", "n")


def duplicate_members(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(number, first, n): a row for each row of a group of two or more that are alike in `keys`, with the group's first
    number and size; however large a group is, it is never one row."""
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    rows = df.select(digest.alias("key"), F.col(number).alias("number"))
    groups = rows.groupBy("key").agg(F.min("number").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(groups, "key").select(F.col("number").alias(number), "first", "n")


def first_earlier(df: DataFrame, key: str, position: str) -> DataFrame:
    """Add `same_as`: the position of the first row with the same key, for all rows but that; null keys match none."""
    first = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(position).alias("__first"))
    return df.join(first, df[key] == first["__key"], "left").withColumn("same_as", F.when(F.col(position) > F.col("__first"), F.col("__first"))).drop("__key", "__first")


def added_since(now: DataFrame, before: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of `now` that `before` hasn't got; of rows that are alike all stay or none does. Nulls equal nulls."""
    return now.join(before, all_equal(now, before, on or now.columns), "left_anti")


def two_way(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows added and removed, told apart in `change`."""
    return added_since(now, before).withColumn("change", F.lit("added")).unionByName(added_since(before, now).withColumn("change", F.lit("removed")))


def classify_changes(before: DataFrame, now: DataFrame, key: str, words: list[str], places: list[str], styles: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(key, change) of what was there before: deleted, else reworded, else moved by over `tolerance`, else restyled."""
    b, n = before.alias("b"), now.withColumn("__there", F.lit(True)).alias("n")
    differs = lambda cols: reduce(lambda x, y: x | y, [~F.col(f"b.{c}").eqNullSafe(F.col(f"n.{c}")) for c in cols])
    moved = reduce(lambda x, y: x | y, [F.abs(F.col(f"b.{c}") - F.col(f"n.{c}")) > tolerance for c in places])
    change = F.when(F.col("n.__there").isNull(), "deleted").when(differs(words), "reworded").when(F.coalesce(moved, F.lit(False)), "moved").when(differs(styles), "restyled")
    return b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "left").select(F.col(f"b.{key}").alias(key), change.alias("change")).filter("change IS NOT NULL")


def merge_config(mine: DataFrame, theirs: DataFrame, key: str, value: str, replace: bool) -> DataFrame:
    """(key, value, outcome) of two settings tables: added, kept or replaced where both have a key and differ."""
    m, t = mine.select(F.col(key).alias("k"), F.col(value).alias("m"), F.lit(True).alias("has_m")), theirs.select(F.col(key).alias("k2"), F.col(value).alias("t"), F.lit(True).alias("has_t"))
    both = m.join(t, F.col("k") == F.col("k2"), "full_outer")
    clash = F.col("has_m") & F.col("has_t") & ~F.col("m").eqNullSafe(F.col("t"))
    outcome = F.when(F.col("has_m").isNull(), "added").when(F.coalesce(clash, F.lit(False)), "replaced" if replace else "kept").otherwise("same")
    chosen = F.when(F.col("has_m").isNull(), F.col("t")).when(F.coalesce(clash, F.lit(False)) & F.lit(replace), F.col("t")).otherwise(F.col("m"))
    return both.select(F.coalesce("k", "k2").alias(key), chosen.alias(value), outcome.alias("outcome"))


def tidied(code: Column, maker: str) -> Column:
    """A code without case, blanks, dashes, underscores and the maker's name before it."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(code)), "[ _-]", ""), f"^{re.escape(maker)}", "")


def by_code(asked: DataFrame, code: str, stock: DataFrame, own: str, also: str, order: str, maker: str) -> DataFrame:
    """Each asked row with the `order` of the first stock that has its code, as its own or among those it is also sold
    under; null where none has."""
    names = stock.select(F.col(order), F.explode(F.array_append(F.col(also), F.col(own))).alias("name"))
    first = names.groupBy(tidied(F.col("name"), maker).alias("__key")).agg(F.min(order).alias(order))
    return asked.withColumn("__key", tidied(F.col(code), maker)).join(first, "__key", "left").drop("__key")


def by_name(asked: DataFrame, wanted: str, names: DataFrame, name: str, order: str) -> DataFrame:
    """(wanted, order): each distinct wanted name with the first of `names` that is the same but for case and what is
    no letter or figure; else the first that has it inside; null where none has. A name without letters finds nothing.

    What a name could be inside of is looked for by a piece of up to three characters of it, the one that fewest names
    have; so only those are compared.
    """
    from tallyframe.functions.text import squash

    keys = written(asked.select(F.col(wanted).alias("wanted"), squash(F.col(wanted)).alias("key")).distinct(), "wanted")
    known = written(names.groupBy(squash(F.col(name)).alias("name")).agg(F.min(order).alias("first")).filter("name <> ''"), "names")
    exact = keys.join(known, F.col("key") == F.col("name")).select("wanted", F.col("first").alias("exact"))
    rest = keys.join(exact, "wanted", "left_anti").filter("key <> ''")
    pieces = lambda t, n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, n))
    long = F.least(F.length("key"), F.lit(3))
    held = known.select("name", "first", F.explode(F.flatten(F.array(*[F.when(F.length("name") >= n, pieces(F.col("name"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))).alias("piece")).distinct()
    rare = held.groupBy("piece").agg(F.count("*").alias("n"))
    asks = rest.select("wanted", "key", F.explode(F.array_distinct(pieces(F.col("key"), long))).alias("piece")).join(rare, "piece").groupBy("wanted", "key").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.count("*").alias("met"), F.first(F.size(F.array_distinct(pieces(F.col("key"), long)))).alias("all"))
    inside = asks.filter("met = all").join(held, "piece").filter(F.contains("name", "key")).groupBy("wanted").agg(F.min("first").alias("inside"))
    return keys.join(exact, "wanted", "left").join(inside, "wanted", "left").select(F.col("wanted").alias(wanted), F.coalesce("exact", "inside").alias(order))


def for_every(df: DataFrame, kind: str, every: str) -> DataFrame:
    """Rows by `target`, each kind that occurs: a kind's own rows, and the rows of kind `every` for each other one too."""
    own = df.withColumn("target", F.col(kind))
    # The kinds are one row, a list of distinct names, whatever the number of rows; Spark sends it along if it is small.
    kinds = df.filter(F.col(kind) != every).agg(F.collect_set(kind).alias("__kinds"))
    shared = df.filter(F.col(kind) == every).crossJoin(kinds).withColumn("target", F.explode("__kinds")).drop("__kinds")
    return own.unionByName(shared)


def latest_match(asked: DataFrame, log: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    """Each asked row with the payload of the newest log entry of its key, and `known`; unknown ones stay."""
    newest = log.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*payload), order).alias("__last"))
    out = asked.join(newest, asked[key].eqNullSafe(newest["__key"]), "left")
    return out.select(*[asked[c] for c in asked.columns], F.col("__last").isNotNull().alias("known"), *[F.col(f"__last.{c}").alias(f"last_{c}") for c in payload])


def tolerant_anti(left: DataFrame, right: DataFrame, keys: list[str], at: str, tolerance: int) -> DataFrame:
    """Rows of `left` with no row of `right` of the same keys within `tolerance` (whole numbers).

    Both are put into bins as wide as the tolerance; each right row stands in its own bin and the two beside it, so the
    join is on equal bins.
    """
    bins = F.floor(F.col(at) / max(1, tolerance))
    l_ = left.withColumn("__bin", bins)
    near = F.array(bins - 1, bins, bins + 1)
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(at).alias("__at"), F.explode(near).alias("__bin2"))
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__bin") == F.col("__bin2"), F.abs(F.col(at) - F.col("__at")) <= tolerance])
    return l_.join(r, match, "left_anti").drop("__bin")


def grid_anti(left: DataFrame, right: DataFrame, page: str, radius: int) -> DataFrame:
    """Cells (page, x, y) of `left` with no cell of `right` within `radius` in both directions.

    Each right cell is spread over its neighbourhood, made distinct, and joined on equality.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    wide = right.select(page, F.col("y"), F.explode(F.transform(steps, lambda s: F.col("x") + s)).alias("x")).distinct()
    wide = wide.select(page, "x", F.explode(F.transform(steps, lambda s: F.col("y") + s)).alias("y")).distinct()
    return left.join(wide, [page, "x", "y"], "left_anti")


def containing(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, wanted_col: str, inner: int = 8) -> DataFrame:
    """(item, id): documents that have an item's whole text somewhere in theirs; an empty or null text is nowhere.

    Documents are asked for by a run of words of the item: its first `inner` words, or all it has, but for its own first and
    last word, as these may be parts of longer ones. Items without three words are asked for by their first letters,
    four at most. What goes through the join are hashes of runs and ids; texts are then read once more, those of
    candidates only, and compared as a whole.
    """
    parts = F.split(F.col("wanted"), " ")
    wanted = items.select(F.col(item_col).alias("item"), F.col(wanted_col).alias("wanted")).filter("wanted <> ''").withColumn("n", F.greatest(F.least(F.size(parts) - 2, F.lit(inner)), F.lit(0)))
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    letters = F.least(F.length("wanted"), F.lit(4))
    keyed = wanted.withColumn("kind", F.when(F.col("n") > 0, F.col("n")).otherwise(-letters)).withColumn("key", F.when(F.col("n") > 0, F.xxhash64(hashed(F.slice(parts, 2, F.col("n"))))).otherwise(F.xxhash64(F.substr("wanted", F.lit(1), letters))))
    keyed = written(keyed.select("item", "wanted", "kind", "key"), "items")
    kinds = [r["kind"] for r in keyed.select("kind").distinct().collect()]  # `inner` and four lengths at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not kinds:
        return keyed.select(F.col("item").alias(item_col)).join(texts.select(F.col("id").alias(id_col)).limit(0), F.lit(False))

    def runs(kind: int) -> Column:
        if kind > 0:
            return F.transform(F.sequence(F.lit(1), F.size("hashes") - kind + 1), lambda i: F.xxhash64(F.slice("hashes", i, kind)))
        return F.transform(F.sequence(F.lit(1), F.length("text") + kind + 1), lambda i: F.xxhash64(F.substr("text", i, F.lit(-kind))))

    long = lambda k: F.size("hashes") >= k if k > 0 else F.length("text") >= -k
    each = [F.when(long(k), F.transform(F.array_distinct(runs(k)), lambda key: F.struct(F.lit(k).alias("kind"), key.alias("key")))).otherwise(F.array().cast("array<struct<kind:int,key:bigint>>")) for k in kinds]
    met = texts.withColumn("hashes", hashed(F.split("text", " "))).select("id", F.explode(F.flatten(F.array(*each))).alias("r")).select("id", "r.kind", "r.key")
    asked = written(met.join(keyed.select("item", "kind", "key"), ["kind", "key"]).select("id", "item").distinct(), "candidates")
    found = texts.join(asked, "id").join(keyed.select("item", "wanted"), "item").filter(F.contains("text", "wanted"))
    return found.select(F.col("item").alias(item_col), F.col("id").alias(id_col)).distinct()


def shared_targets(df: DataFrame, target: str, source: str) -> DataFrame:
    """Targets that more than one source would write, whatever their case."""
    return df.groupBy(F.lower(target).alias("target")).agg(F.sort_array(F.collect_set(source)).alias("sources")).filter(F.size("sources") > 1)


def conflicts(df: DataFrame, name: str, digest: str) -> DataFrame:
    """Names with more than one content."""
    return df.groupBy(name).agg(F.count_distinct(digest).alias("contents")).filter("contents > 1")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Parts one after the other, with the part's number."""
    return reduce(lambda a, b: a.unionByName(b), [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts, 1)])


def merge_entities(df: DataFrame, keys: list[Column], worth: Column, order: str, fields: list[str]) -> DataFrame:
    """One row for each key: the worthiest (of equals the earliest), its missing fields from the earliest that has them."""
    rows = df.select(*[k.alias(f"key{i}") for i, k in enumerate(keys)], F.struct(worth.alias("w"), (-F.col(order)).alias("o")).alias("rank"), F.col(order).alias("o"), *fields)
    best = [F.coalesce(F.max_by(f, "rank"), F.min_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col("o")))).alias(f) for f in fields]
    return rows.groupBy(*[f"key{i}" for i in range(len(keys))]).agg(*best, F.count("*").alias("seen"))


def newest(df: DataFrame, by: list[str], order: str, keep: int) -> DataFrame:
    """The last `keep` rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep).drop("__n")
