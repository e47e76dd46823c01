"""Arriving files: looked at until they are settled, then handled once.

Spark's file source tells files apart by path alone, so one that is written anew would be passed over. Here a look is
(path, size, modified); what was handled is kept in a ledger by all three. `Folder.sweep` compares a look with the one
before by a join; `Folder.follow` reads looks as a stream and keeps what it knows of each path as state.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tallyframe.operators import scan
from tallyframe.operators.tables import written

LOOK = ["path", "size", "modified"]


def settled(before: DataFrame, now: DataFrame) -> DataFrame:
    """Add `settled` to looks: not empty, and as large and as old as in the look before."""
    seen = before.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("modified").alias("m"))
    same = (F.col("size") == F.col("s")) & (F.col("modified") == F.col("m")) & (F.col("size") > 0)
    return now.join(seen, now["path"] == seen["p"], "left").withColumn("settled", F.coalesce(same, F.lit(False))).drop("p", "s", "m")


def decided(before: DataFrame, now: DataFrame, ledger: DataFrame, why_not: Column | None = None, again: bool = False) -> DataFrame:
    """(path, size, modified, verdict): left for a reason, already done or failed, still arriving, or to do, in that
    order. A file that was written anew under its name is new; `again` asks no ledger."""
    looks = settled(before, now)
    known = ledger.groupBy(*LOOK).agg(F.max_by("outcome", "at").alias("outcome"))
    out = looks.join(known, LOOK, "left")
    verdict = F.when(F.col("outcome").isNotNull() & F.lit(not again), F.concat(F.lit("already "), F.col("outcome"))).when(~F.col("settled"), "arriving").otherwise("do")
    if why_not is not None:
        verdict = F.when(why_not.isNotNull(), F.concat(F.lit("left: "), why_not)).otherwise(verdict)
    return out.select(*LOOK, verdict.alias("verdict"))


#: What is kept of a path between looks: its last size and time of change, and whether it was given out as they are.
STATE = "size long, modified long, given boolean"


def arriving(looks: DataFrame) -> DataFrame:
    """A stream of looks (path, size, modified, turn) -> the files to be handled, as (path, size, modified, turn).

    State is kept by path, so a look meets only what is known of its own file, however many there are: a file is given
    out at the first look that finds it as the look before did, not empty, and again after it was changed.
    """

    def step(key, parts, state):
        size, modified, given = state.get if state.exists else (-1, -1, False)
        out = []
        for row in sorted((r for part in parts for r in part[["size", "modified", "turn"]].itertuples(index=False)), key=lambda r: r.turn):
            if (row.size, row.modified) != (size, modified):
                size, modified, given = int(row.size), int(row.modified), False
            elif size > 0 and not given:
                out.append((key[0], size, modified, int(row.turn)))
                given = True
        state.update((size, modified, given))
        yield pd.DataFrame(out, columns=["path", "size", "modified", "turn"])

    return looks.groupBy("path").applyInPandasWithState(step, "path string, size long, modified long, turn int", STATE, "append", GroupStateTimeout.NoTimeout)


#: Listings that may fail in a row before a watch gives up, and the seconds between looks.
GIVE_UP_AFTER, SHORTEST, LONGEST, USUAL = 10, 1, 3600, 2


def every(seconds: int = USUAL) -> str:
    """The time between two looks, for a trigger."""
    if not SHORTEST <= seconds <= LONGEST:
        raise ValueError(f"looks are {SHORTEST} to {LONGEST} seconds apart")
    return f"{seconds} seconds"


class Folder:
    """Sweeps over a folder; the ledger and the last look are Parquet tables beside a stream's checkpoint."""

    def __init__(self, spark: SparkSession, folder: str, state: str):
        self.spark, self.folder, self.state, self.failed = spark, folder, state, 0

    def listing(self) -> DataFrame:
        from tallyframe.sources.files import listing

        return listing(self.spark, self.folder)

    def read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.state}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.schema(schema).parquet(f"{self.state}/{name}") if fs.exists(path) else self.spark.createDataFrame([], schema)

    def sweep(self, turn: int, handle: Callable[[DataFrame], DataFrame], again: bool = False) -> DataFrame:
        """One look; `handle` gets what is to be done and returns (path, outcome). The look and the outcomes are written
        under the turn's number: a turn that is run again writes over its own."""
        schema = "path string, size long, modified long"
        # The last look there is: turns whose listing failed have left none.
        looks = self.read("looks", f"{schema}, turn int").filter(F.col("turn") < turn)
        before = looks.filter(F.col("turn") == (looks.agg(F.max("turn").alias("t")).first()["t"] or 0))
        ledger = self.read("ledger", f"{schema}, outcome string, at int, turn int").filter(F.col("turn") != turn)
        # The listing changes while we work: one look is written and everything follows from it.
        self.listing().write.mode("overwrite").parquet(f"{self.state}/looks/turn={turn}")
        now = self.spark.read.schema(schema).parquet(f"{self.state}/looks/turn={turn}")
        verdicts = decided(before, now, ledger, again=again)
        todo = verdicts.filter("verdict = 'do'").drop("verdict")
        done = todo.join(handle(todo), "path").select(*LOOK, "outcome", F.lit(turn).alias("at"))
        done.write.mode("overwrite").parquet(f"{self.state}/ledger/turn={turn}")
        return verdicts

    def look(self, turn: int) -> None:
        """Write a look at the folder for `follow`, as a file of its own."""
        self.listing().withColumn("turn", F.lit(turn)).write.mode("append").parquet(f"{self.state}/stream/looks")

    def follow(self, handle: Callable[[DataFrame], DataFrame], every: str | None = None):
        """A streaming query over the looks that are written, with keyed state of the last one: each batch hands what has
        settled to `handle`, which returns (path, outcome), and writes the ledger of its number, so a batch that is run
        again writes over its own. Without `every` it takes the looks that are there and ends."""
        looks = self.spark.readStream.schema("path string, size long, modified long, turn int").parquet(f"{self.state}/stream/looks")

        def batch(todo: DataFrame, number: int) -> None:
            todo = written(todo, "arrived")  # state is read and written once a batch
            done = todo.join(handle(todo), "path").select(*LOOK, "outcome", F.col("turn").alias("at"))
            done.write.mode("overwrite").parquet(f"{self.state}/stream/ledger/batch={number}")

        trigger = {"processingTime": every} if every else {"availableNow": True}
        return arriving(looks).writeStream.outputMode("append").foreachBatch(batch).trigger(**trigger).option("checkpointLocation", f"{self.state}/stream/checkpoint").start()

    def handled(self) -> DataFrame:
        """The ledger of `follow`."""
        return self.read("stream/ledger", "path string, size long, modified long, outcome string, at int, batch int")

    def tolerant(self, turn: int, handle: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """A sweep of a folder that may go away for a while: nothing where it can't be listed, an error the tenth time in a
        row. What goes wrong after the listing is an error at once."""
        try:
            self.listing().isEmpty()
        except Exception:  # noqa: BLE001  # whatever the file system raises
            self.failed += 1
            if self.failed >= GIVE_UP_AFTER:
                raise
            return None
        self.failed = 0
        return self.sweep(turn, handle)

    def watch(self, handle: Callable[[DataFrame], DataFrame], every: str | None = None, checkpoint: str | None = None):
        """Sweeps as a streaming query: each tick of a rate source is a turn; without `every`, two turns and an end."""
        if every is None:
            for turn in (1, 2):
                out = self.sweep(turn, handle)
            return out
        ticks = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, turn: self.tolerant(turn + 1, handle)).trigger(processingTime=every).option("checkpointLocation", checkpoint or f"{self.state}/checkpoint").start()


def repeats(log: DataFrame, key: str, order: str) -> DataFrame:
    """Add `seen_at`: the order of the latest earlier entry with the same fingerprint; entries are kept, not dropped."""
    rows = scan.before(scan.dealt(log, [key], [order], "log"), [key], seen_at=("last", F.col(order)))
    return rows.select(*[F.col(f"`{c}`") for c in log.columns], "seen_at")


def compacted(ledger: DataFrame, present: DataFrame, most: int = 2000) -> DataFrame:
    """A ledger over its bound cut down: entries of files that are still there, and of the others the newest that fill
    half of the room left."""
    newest = ledger.groupBy("path").agg(F.max_by(F.struct(*[c for c in ledger.columns if c != "path"]), "at").alias("e")).select("path", "e.*")
    here = newest.join(present.select("path").distinct(), "path", "left_semi")
    gone = newest.join(present.select("path").distinct(), "path", "left_anti")
    room = max(0, (most - here.count()) // 2)
    return here.unionByName(gone.orderBy(F.desc("at"), "path").limit(room))
