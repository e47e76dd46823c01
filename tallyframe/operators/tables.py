"""Tables between steps."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Once a table is written nothing reads the shuffles that made it; with this setting Spark deletes them then.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows that one task sorts or groups, where steps are dealt out by `parts_for`.
ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named: with a local master, as in tests, one of
    this machine, for the session; else an error, as other machines could not read what is written here."""
    context = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.getCheckpointDir().isDefined():
        named = context.getCheckpointDir().get()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Driver:
    """What only the driver knows: how many tables are being written and what FREE_SHUFFLES was before, and each thread's
    open `Temporary`s. Functions that are sent to executors take a new one along."""

    def __init__(self) -> None:
        self.lock, self.writing, self.held, self.thread = threading.Lock(), 0, "false", threading.local()

    def __reduce__(self) -> tuple:
        return Driver, ()

    @property
    def open(self) -> list[Temporary]:
        return getattr(self.thread, "open", [])


DRIVER = Driver()


class Freeing:
    """Switches FREE_SHUFFLES on for a session while any table is being written, and back when the last one is."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        with DRIVER.lock:
            if not DRIVER.writing:
                DRIVER.held = self.spark.conf.get(FREE_SHUFFLES)
                self.spark.conf.set(FREE_SHUFFLES, "true")
            DRIVER.writing += 1

    def __exit__(self, *_: object) -> None:
        with DRIVER.lock:
            DRIVER.writing -= 1
            if not DRIVER.writing:
                self.spark.conf.set(FREE_SHUFFLES, DRIVER.held)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Temporary:
    """`with Temporary(spark) as t:` removes the tables that `written` makes inside when it ends, but for `t.keep(table)`.

    What is computed inside must be written or collected inside. Tables that are kept pass to the `Temporary` around it, if
    there is one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Temporary:
        DRIVER.thread.open = [*DRIVER.open, self]
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.paths.remove(table.written_to)
        if len(DRIVER.open) > 1:
            DRIVER.open[-2].paths.append(table.written_to)
        return table

    def __exit__(self, *_: object) -> None:
        DRIVER.thread.open = DRIVER.open[:-1]
        for path in self.paths:
            removed(self.spark, path)


def written(df: DataFrame, name: str, any_row: Column | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: later steps don't begin anew, and a lost executor costs no
    earlier work. The table stays until `forget`, or the end of the `Temporary` around it. Its attribute `any` tells whether
    a condition holds for any row, which is seen as rows are written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    seen, schema = Observation(), df.schema
    if any_row is not None:
        df = df.observe(seen, F.count_if(any_row).alias("n"))
    with Freeing(spark):
        df.write.option("compression", "zstd").parquet(path)
    if DRIVER.open:
        DRIVER.open[-1].paths.append(path)
    table = spark.read.schema(schema).parquet(path)
    table.written_to = path
    table.any = any_row is not None and seen.get.get("n", 0) > 0
    return table


def parts_for(spark: SparkSession, rows: int) -> int:
    """How many tasks a step over so many rows is dealt out to, as `repartition` takes it: ROWS rows each, and no fewer tasks
    than a shuffle has. Shuffles alone have a fixed number of tasks, and are put together by their bytes, of which rows of
    small numbers have next to none."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def forget(*tables: DataFrame) -> None:
    """Remove tables of `written` that nothing reads any more, as those of a round once the next one is written."""
    for table in tables:
        removed(table.sparkSession, table.written_to)
        if DRIVER.open and table.written_to in DRIVER.open[-1].paths:
            DRIVER.open[-1].paths.remove(table.written_to)
