"""A log of what was done: entries are added as JSON lines, the newest are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: entries kept.
KEPT = 500

SCHEMA = "at long, source string, delta string, pages long, additions long, fingerprint string"


def append(entries: DataFrame, path: str) -> None:
    """Add entries to the log's folder."""
    entries.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries; damaged ones, and those without a time or a source, are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).na.drop(subset=["at", "source"])


def recent(spark: SparkSession, path: str, most: int = KEPT) -> DataFrame:
    """The newest entries."""
    return read(spark, path).orderBy(F.desc("at"), "source", "fingerprint").limit(most)


def compact(spark: SparkSession, path: str, to: str, most: int = KEPT) -> DataFrame:
    """A log with the newest entries only, in another folder; the caller puts it in the old one's place."""
    kept = recent(spark, path, most)
    kept.write.mode("errorifexists").json(to)
    return read(spark, to)


def printed_before(files: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Files (path, fingerprint) with the newest entry of their fingerprint; a null fingerprint is unreadable."""
    newest = read(spark, path).groupBy("fingerprint").agg(F.max_by(F.struct("at", "delta"), "at").alias("last"))
    out = files.join(newest, "fingerprint", "left")
    status = F.when(F.col("fingerprint").isNull(), "unreadable").when(F.col("last").isNull(), "new").otherwise("printed")
    return out.select("path", "fingerprint", status.alias("status"), F.col("last.at").alias("at"), F.col("last.delta").alias("delta"))
