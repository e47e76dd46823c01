"""URL filters: exact membership in lists of keys by cascades of Bloom filters, without joining URLs to the lists.

A listed key is a host and the beginning of a path, like `example.net/en/`; it fits the host, its subdomains and paths
that begin so. The corpus's complete key universe is every key of a listed shape (so many host labels, so many
characters of path) that its URLs have. Level 1 of a cascade holds the listed keys. Level 2 holds the universe's other
keys that level 1 takes for listed, level 3 the listed keys that level 2 takes for those, and so on until none is
mistaken. Asked level by level, the first filter that hasn't got a key tells which side it is on, for every key of the
universe without error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import common
from tallyframe.llm.textfeatures import stir

#: Bytes of filters that a shard of keys may come to. A task holds the filters of one shard at a time.
SHARD_BYTES = 8 << 20

#: Keys that meet a copy of their shard's filters in one task, on average.
AT_ONCE = 4_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; path: on to `?`, `#` or the end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass
class Filter:
    """A Bloom filter: the bits of keys by two hashes, taken `turns` times; each level of a cascade has its own."""

    words: np.ndarray
    turns: int
    level: int

    def places(self, a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
        own = stir(a ^ stir(np.full(1, self.level + 1, dtype=np.uint64)))
        return (own + np.uint64(turn) * (b | np.uint64(1))) % np.uint64(64 * len(self.words))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        for turn in range(self.turns):
            at = self.places(a, b, turn)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def bits_for(wrong: float) -> float:
    """Bits a key of a filter that takes another key for one of its own with probability `wrong`."""
    return -np.log(wrong) / np.log(2) ** 2


def filled(a: np.ndarray, b: np.ndarray, wrong: float, level: int) -> Filter:
    """The filter of some keys (a, b: hashes)."""
    size = max(1, int(np.ceil(len(a) * bits_for(wrong) / 64)))
    made = Filter(np.zeros(size, dtype=np.uint64), max(1, round(-np.log2(wrong))), level)
    for turn in range(made.turns):
        at = made.places(a, b, turn)
        np.bitwise_or.at(made.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return made


@dataclass
class Cascade:
    levels: list[Filter]

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key is listed; right for every key of the universe."""
        out, unsure = np.zeros(len(a), dtype=bool), np.arange(len(a))
        for depth, level in enumerate(self.levels):
            has = level.has(a[unsure], b[unsure])
            out[unsure[~has]] = depth % 2 == 1
            unsure = unsure[has]
        out[unsure] = len(self.levels) % 2 == 1
        return out


#: A filter as a row: the list (verdict) and shard that it belongs to, and its level.
FILTER = "list int, shard int, level int, turns int, words binary"


def unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy().view(np.uint64)


def built(keys: DataFrame, wrong: dict[int, float], level: int) -> DataFrame:
    """(list, shard, a, b) -> the filter of each list and shard; one task fills a shard's filter, whose size is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            made = filled(*(np.concatenate([h[k] for h in held]) for k in (0, 1)), wrong[at[0]], level)
            yield pa.RecordBatch.from_pydict({"list": pa.array([at[0]], pa.int32()), "shard": pa.array([at[1]], pa.int32()), "level": pa.array([level], pa.int32()), "turns": pa.array([made.turns], pa.int32()), "words": pa.array([made.words.tobytes()], pa.binary())})

        for batch in batches:
            for own, part in common.alike(batch, "list", "shard"):
                if at is not None and own != at:
                    yield from told()
                    held = []
                at = own
                held.append((unsigned(part, "a"), unsigned(part, "b")))
        if at is not None:
            yield from told()

    return keys.select("list", "shard", "a", "b").repartition("list", "shard").sortWithinPartitions("list", "shard").mapInArrow(run, FILTER)


class Held:
    """The filters that a task holds: for each list a cascade, all of one shard."""

    def __init__(self):
        self.lists: dict[int, Cascade] = {}

    def add(self, filters: list[dict]) -> None:
        for f in sorted(filters, key=lambda f: (f["list"], f["level"])):
            self.lists.setdefault(f["list"], Cascade([])).levels.append(Filter(np.frombuffer(f["words"], dtype=np.uint64), f["turns"], f["level"]))


Answer = Callable[[pa.RecordBatch, Held], pa.RecordBatch]


def met(keys: DataFrame, filters: DataFrame, shards: int, answer: Answer, schema: str) -> DataFrame:
    """What `answer` says to batches of keys (shard and others) that stand beside the filters of their shard.

    With one shard its filters go along with the tasks, and keys stay where they are. With more, keys are dealt by
    shard to as many tasks as their number asks for, each with a copy of the shard's filters before it; so keys that
    very many rows have are no one task's burden.
    """
    if shards == 1:
        held = Held()
        held.add([r.asDict() for r in filters.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield answer(batch, held)

        return keys.mapInArrow(run, schema)
    counts = {r["shard"]: r["n"] for r in keys.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    parts = [max(1, -(-counts.get(s, 0) // AT_ONCE)) for s in range(shards)]
    of = F.element_at(F.array(*[F.lit(n) for n in parts]), F.col("shard") + 1)
    # Which copy a key meets follows from its row's values, so a lost task deals alike when run again.
    dealt = keys.withColumn("part", F.pmod(F.xxhash64(*[F.col(c) for c in keys.columns]), of).cast("int"))
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0), of - 1)))
    names = [c for c in filters.columns if c != "shard"]
    blank = {f.name: f.dataType for f in keys.schema if f.name != "shard"}
    both = copies.select("shard", "part", F.lit(0).alias("kind"), *names, *[F.lit(None).cast(t).alias(f"k_{c}") for c, t in blank.items()]).unionAll(
        dealt.select("shard", "part", F.lit(1).alias("kind"), *[F.lit(None).cast(filters.schema[c].dataType).alias(c) for c in names], *[F.col(c).alias(f"k_{c}") for c in blank])
    )

    def run_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Held()
        for batch in batches:
            for (shard, part, kind), rows in common.alike(batch, "shard", "part", "kind"):
                if (shard, part) != at:
                    at, held = (shard, part), Held()
                if kind == 0:
                    held.add(rows.select(names).to_pylist())
                    continue
                yield answer(pa.RecordBatch.from_arrays([rows.column(f"k_{c}") for c in blank], names=list(blank)), held)

    return both.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "list", "level").mapInArrow(run_dealt, schema)


def cascades(universe: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """(list, a, b, listed), every key of the universe once for each list -> filters of all lists' cascades, by shard,
    and the number of shards."""
    count = {(r["list"], r["listed"]): r["n"] for r in universe.groupBy("list", "listed").agg(F.count("*").alias("n")).collect()}
    lists = sorted({k for k, _ in count})
    # The first level is strict, so that few of a large universe pass; the others halve what is left.
    wrong = {k: min(0.5, max(1e-9, count.get((k, True), 0) / max(1, count.get((k, False), 0)))) for k in lists}
    size = sum(count.get((k, True), 0) * (bits_for(wrong[k]) + 4) / 8 for k in lists)
    shards = max(1, int(-(-size // shard_bytes)))
    dealt = universe.withColumn("shard", shard_of(F.col("a"), shards))
    side = {s: dealt.filter(F.col("listed") == s).select("list", "shard", "a", "b") for s in (True, False)}
    parts, level, encode = [], 0, True
    while True:
        now = common.written(built(side[encode], wrong if not level else dict.fromkeys(lists, 0.5), level), "filters")
        parts.append(now)
        encode, level = not encode, level + 1

        def mistaken(batch: pa.RecordBatch, held: Held) -> pa.RecordBatch:
            a, b, own = unsigned(batch, "a"), unsigned(batch, "b"), batch.column("list").to_numpy()
            keep = np.zeros(len(a), dtype=bool)
            for k, c in held.lists.items():
                at = np.flatnonzero(own == k)
                keep[at] = c.levels[-1].has(a[at], b[at])
            return batch.select(["list", "a", "b"]).filter(pa.array(keep))

        # A list or shard without a filter at this level has no key left that could be mistaken.
        left = common.written(met(side[encode], now, shards, mistaken, "list int, a long, b long"), "mistaken")
        side[encode] = left.withColumn("shard", shard_of(F.col("a"), shards)).select("list", "shard", "a", "b")
        if left.isEmpty():
            return reduce(DataFrame.unionAll, parts), shards
        if level > 100:
            raise ValueError("keys of both sides have the same hashes")


def shard_of(a: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(a), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of listed shapes that a URL has, as an array, longest first (of equals the longer host)."""
    labels = F.when(host == "", F.array().cast("array<string>")).otherwise(F.split(host, r"\."))
    known = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(long).alias("long")) for n, long in shapes])
    fitting = F.filter(known, lambda s: (F.size(labels) >= s["n"]) & (F.length(path) >= s["long"]))

    def key(s: Column) -> Column:
        own = F.array_join(F.slice(labels, F.size(labels) - s["n"] + 1, s["n"]), ".")
        whole = F.concat(own, F.substr(path, F.lit(1), s["long"]))
        return F.struct((-F.length(whole)).alias("l"), (-F.length(own)).alias("h"), whole.alias("key"))

    return F.transform(F.array_sort(F.transform(fitting, key)), lambda c: c["key"])


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(rule, verdict) keys against all URLs -> (id, host, path, rule, verdict).

    rules: `rule` is a host and the beginning of a path (from `/` on), `verdict` block or allow, of a rule listed twice
    the lesser. The longest rule that fits gives the verdict. A URL whose keys are on neither list gets `otherwise`:
    what isn't listed is let through. A null URL, or one without `://`, has an empty host and path and no rule. Every
    row is judged, repeated ones alike; other columns play no part; no rows give no rows, no rules let all through.

    Each verdict's list has a cascade over the keys of all URLs, parted by a hash of the key into shards whose
    filters have about `shard_bytes`. With one shard the filters go along with the tasks that read the pages; with
    more, keys travel to their shard's filters, and what they find is put together again by row.
    """
    spark = pages.sparkSession
    common.bounded_batches(spark)
    rules = rules.groupBy("rule").agg(F.min("verdict").alias("verdict")).filter(F.col("rule").isNotNull())
    slash = F.locate("/", F.col("rule"))
    of = rules.select(F.size(F.split(F.substring_index("rule", "/", 1), r"\.")).alias("n"), (F.length("rule") - slash + 1).alias("long"))
    # Labels of a host times characters of a path: a few hundred shapes, however long the lists.
    shapes = sorted({(r["n"], r["long"]) for r in of.distinct().collect()})
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")).select("id", host.alias("host"), path.alias("path"))
    if not shapes:
        return split.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    asked = split.withColumn("keys", candidates(F.col("host"), F.col("path"), shapes))
    verdicts = sorted(r["verdict"] for r in rules.select("verdict").distinct().collect())
    keys = asked.select(F.explode("keys").alias("key"), F.lit(None).cast("string").alias("verdict")).unionByName(rules.withColumnRenamed("rule", "key"))
    once = common.written(keys.groupBy("key").agg(F.max("verdict").alias("verdict")).select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"), "verdict"), "universe")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("list"), F.coalesce(F.col("verdict") == v, F.lit(False)).alias("listed")) for k, v in enumerate(verdicts)]))
    filters, shards = cascades(once.select("a", "b", each.alias("e")).select("e.list", "a", "b", "e.listed"), shard_bytes)
    kind = pages.schema[id_col].dataType.simpleString()

    def which(held: Held, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The list that each key is on, -1 for none."""
        out = np.full(len(a), -1, dtype=np.int32)
        for v, c in held.lists.items():
            out[c.listed(a, b)] = v
        return out

    if shards == 1:

        def by_row(batch: pa.RecordBatch, held: Held) -> pa.RecordBatch:
            lists = batch.column("keys")
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            on = which(held, *(flat.field(k).to_numpy().view(np.uint64) for k in ("a", "b")))
            # Keys come longest first: each row's first listed one is its rule.
            row, hit = np.repeat(np.arange(len(sizes)), sizes), np.flatnonzero(on >= 0)
            rows, first = np.unique(row[hit], return_index=True)
            rule, verdict = [None] * len(sizes), [otherwise] * len(sizes)
            for r, k in zip(rows.tolist(), hit[first].tolist(), strict=True):
                rule[r], verdict[r] = flat.field("key")[k].as_py(), verdicts[on[k]]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

        sent = asked.select("id", "host", "path", F.transform("keys", lambda k: F.struct(k.alias("key"), F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))).alias("keys"))
        return met(sent, filters, 1, by_row, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)

    def by_key(batch: pa.RecordBatch, held: Held) -> pa.RecordBatch:
        on = which(held, unsigned(batch, "a"), unsigned(batch, "b"))
        found = batch.select(["row", "at"]).append_column("list", pa.array(on))
        return found.filter(pa.array(on >= 0))

    rows = common.written(asked.withColumn("row", F.monotonically_increasing_id()), "asked")
    single = rows.select("row", F.posexplode("keys").alias("at", "key")).select("row", "at", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))
    found = met(single.select("row", "at", "a", "b", shard_of(F.col("a"), shards).alias("shard")), filters, shards, by_key, "row long, at int, list int")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("id", kind), ("host", "string"), ("path", "string"), ("keys", "array<string>"))]
    hits = found.groupBy("row").agg(F.min(F.struct("at", "list")).alias("best")).select("row", *empty, "best")
    together = rows.select("row", "id", "host", "path", "keys", F.lit(None).cast("struct<at:int,list:int>").alias("best")).unionAll(hits).groupBy("row")
    given = [F.first(c, ignorenulls=True).alias(c) for c in ("id", "host", "path", "keys", "best")]
    rule = F.get("keys", F.col("best.at"))
    verdict = F.coalesce(F.get(F.array(*[F.lit(v) for v in verdicts]), F.col("best.list")), F.lit(otherwise))
    return together.agg(*given).select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))
