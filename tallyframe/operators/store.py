"""Named documents that are saved, read, listed and deleted: jobs, profiles, settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.text import valid_name
from tallyframe.operators.tables import written


class NoSuchName(KeyError):
    """A name that nothing is saved under; says what there is."""


class Store:
    """Documents (JSON texts) by name, in a folder of Parquet files: a change adds rows, and of a name the last counts.

    Nothing is rewritten, so readers see whole states; a version is one folder, which fails if another run wrote it.
    """

    schema = "name string, document string, deleted boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> int:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return max((int(s.getPath().getName().removeprefix("version=")) for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")), default=0) if fs.exists(root) else 0

    def save(self, documents: DataFrame) -> None:
        """Save rows (name, document): letters, figures, dashes and underscores make a name, 64 at most."""
        rows = written(documents.select("name", "document", F.lit(False).alias("deleted")), "documents")
        bad = rows.filter(~F.coalesce(valid_name(F.col("name")), F.lit(False))).select("name").first()
        if bad:
            raise ValueError(f"{bad['name']!r} is no name")
        self.add(rows)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("errorifexists").parquet(f"{self.path}/version={self.versions() + 1}")

    def all(self) -> DataFrame:
        """(name, document), one row for each name; documents that are no JSON are left out, and stop no others."""
        if not self.versions():
            return self.spark.createDataFrame([], "name string, document string")
        rows = self.spark.read.schema(f"{self.schema}, version int").parquet(self.path)
        last = rows.groupBy("name").agg(F.max_by(F.struct("document", "deleted"), F.struct("version", "document")).alias("l")).filter("NOT l.deleted").select("name", "l.document")
        return last.filter(F.json_object_keys("document").isNotNull())

    def load(self, name: str) -> dict:
        found = self.all().filter(F.col("name") == name).first()
        if found is None:
            names = [r["name"] for r in self.all().select("name").orderBy("name").limit(100).collect()]
            raise NoSuchName(f"nothing is saved as {name!r}; there is {', '.join(names) or 'nothing'}")
        return json.loads(found["document"])

    def delete(self, name: str) -> bool:
        """Whether there was one."""
        if self.all().filter(F.col("name") == name).isEmpty():
            return False
        self.add(self.spark.createDataFrame([(name, None, True)], self.schema))
        return True


def run_job(spark: SparkSession, job: dict, tables: dict[str, DataFrame], **given: object) -> DataFrame:
    """Run a saved job: {"statement": SQL with :parameters and {tables}, "parameters": {name: default or null}}.

    Values are bound, not pasted. A parameter without a value raises, as does one that the job hasn't got.
    """
    wanted = job.get("parameters", {})
    if unknown := sorted(set(given) - set(wanted)):
        raise ValueError(f"the job has no parameters {', '.join(unknown)}")
    values = {k: given.get(k, v) for k, v in wanted.items()}
    if missing := sorted(k for k, v in values.items() if v is None):
        raise ValueError(f"the job needs {', '.join(missing)}")
    return spark.sql(job["statement"], args=values, **tables)
