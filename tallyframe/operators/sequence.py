"""Numbers of rows and counters that carry on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.measure import saturating_add
from tallyframe.operators.tables import written


def from_row(df: DataFrame, ordinal: str, first: int) -> DataFrame:
    """The rows from an ordinal on; their numbers stay."""
    return df.filter(F.col(ordinal) >= first)


def renumbered(df: DataFrame, ordinal: str, start: int, first: int = 1) -> DataFrame:
    """Add `number`: the ordinal, so shifted that `first` becomes `start`; it stops at the largest whole number."""
    return df.withColumn("number", saturating_add(F.col(ordinal) - first, F.lit(max(1, start)).cast("long")))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add `number`, from 1 in the given order, without bringing all rows to one task.

    Rows are range-partitioned and numbered inside their partition; that is written down, as another run might part
    them elsewhere. How many rows precede a partition is then added.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(n, *[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    inside = written(placed.withColumn("__inside", F.row_number().over(Window.partitionBy("__part").orderBy(*order))), "numbered")
    counts = inside.groupBy("__part").count()
    before = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row for each partition
    return inside.join(before, F.col("__part") == F.col("__p")).withColumn("number", F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__p", "__before")


def next_number(df: DataFrame, number: str = "number") -> DataFrame:
    """One row: the number after the last, 1 for an empty list."""
    return df.agg(F.coalesce(F.max(number) + 1, F.lit(1)).alias("next"))


class Moved(RuntimeError):
    """A counter that another run has moved meanwhile."""


class SeriesCounters:
    """Next numbers of series, in a small Parquet table of versions; a counter advances only from where it was read.

    Each change writes the next version's folder, which fails if another run has written it, so of two runs that
    started from one version one is told.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        """The last version written, 0 before the first."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), default=0)

    def all(self) -> dict[str, int]:
        v = self.version()
        return {r["name"]: r["next"] for r in self.spark.read.parquet(f"{self.path}/v{v}").collect()} if v else {}

    def start(self, name: str) -> int:
        return self.all().get(name, 1)

    def reached(self, name: str, started: int, upcoming: int) -> None:
        """Advance a series that a run read at `started` to `upcoming`; nothing written, nothing advanced."""
        version = self.version()
        held = self.all()
        if held.get(name, 1) != started:
            raise Moved(f"{name} was at {started} and is at {held.get(name, 1)}")
        if upcoming != started:
            rows = [(k, v) for k, v in {**held, name: upcoming}.items()]
            self.spark.createDataFrame(rows, "name string, next long").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/v{version + 1}")
