"""Lists: strict CSV, counted rows, JSON lines, and CSV reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.text import trimmed
from tallyframe.operators.sequence import numbered
from tallyframe.operators.tables import written


class ListError(ValueError):
    """A list that can't be taken as it is."""


def counted(spark: SparkSession, n: int, most: int = 50_000) -> DataFrame:
    """Rows 1 to n without columns."""
    if not 0 < n <= most:
        raise ListError(f"1 to {most} rows can be counted")
    return spark.range(1, n + 1).withColumnRenamed("id", "number")


def counted_for(df: DataFrame, n: str, most: int = 50_000) -> DataFrame:
    """Each row as often as it asks for, with `number` from 1; none for rows that ask for none or for over `most`."""
    fits = F.when(F.col(n).between(1, most), F.sequence(F.lit(1).cast("long"), F.col(n).cast("long")))
    return df.withColumn("number", F.explode(fits))


def records(files: DataFrame) -> DataFrame:
    """(path, content as text) -> (path, at, cells): the records of each file, in order, `at` from 0.

    Commas part cells; LF, CRLF or a lone CR end a record; a quote turns quoting on and off wherever it stands, two of
    them inside quotes are one, and a quote that is never closed takes in all that follows. A file is one row until it
    is cut, so files of a list are read side by side; a byte order mark is dropped.

    Cut at quotes, every second piece is quoted; an empty piece between two quoted ones is a doubled quote. A mark at the
    end, taken off again, keeps the last piece from being empty, so a piece is judged by itself.
    """
    # Separators of units and of records; where a list has them itself they are spelled with an escape meanwhile, and so is
    # the escape.
    between, after, escape = "\u001f", "\u001e", "\ufdd0"
    end = f"{escape}z"
    spelled = {escape: f"{escape}a", between: f"{escape}b", after: f"{escape}c"}
    whole = F.regexp_replace(F.col("content"), "^\ufeff", "")
    for mark, said in spelled.items():
        whole = F.replace(whole, F.lit(mark), F.lit(said))

    def read(cell: Column) -> Column:
        for mark, said in reversed(spelled.items()):
            cell = F.replace(cell, F.lit(said), F.lit(mark))
        return cell

    pieces = F.split(F.concat(whole, F.lit(end)), '"')
    plain = lambda t: F.translate(F.regexp_replace(t, "\r\n?", "\n"), ",\n", between + after)
    kept = F.transform(pieces, lambda t, i: F.when(i % 2 == 1, t).when((i > 0) & (t == ""), '"').otherwise(plain(t)))
    lines = files.select("path", F.posexplode(F.split(F.replace(F.array_join(kept, ""), F.lit(end)), after)).alias("at", "line"))
    return lines.select("path", "at", F.transform(F.split("line", between), read).alias("cells"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV list as text columns and `number`, strictly (see `records`).

    The header's names are trimmed and values are trimmed of white space; empty values stay empty texts. Records
    without any value are left out; one with more or fewer cells than the header raises, as do a list without rows,
    without columns, or with bytes that are no UTF-8. Of a folder each file begins with the same header, and files come
    in the order of their paths. Numbers go by place.
    """
    text = F.col("content").cast("string")
    files = spark.read.format("binaryFile").load(path).select("path", text.alias("content"), F.is_valid_utf8(text).alias("good"))
    bad = files.filter("NOT good").select("path").first()
    if bad:
        raise ListError(f"{bad['path']} isn't UTF-8 text")
    trim = lambda cells: F.transform(cells, trimmed)
    rows = written(records(files).select("path", "at", trim(F.col("cells")).alias("cells")), "list")
    heads = rows.filter("at = 0").groupBy("cells").agg(F.min("path").alias("path")).orderBy("path").limit(2).collect()
    head = heads[0]["cells"] if heads else []
    if not any(head):
        raise ListError("the list has no columns")
    if len(heads) > 1:
        raise ListError(f"{heads[1]['path']} has another header than {heads[0]['path']}")
    body = rows.filter((F.col("at") > 0) & F.exists("cells", lambda c: c != ""))
    odd = body.agg(F.count("*").alias("n"), F.min(F.when(F.size("cells") != len(head), F.struct("path", "at", F.size("cells").alias("cells")))).alias("odd")).first()
    if odd["odd"] is not None:
        raise ListError(f"record {odd['odd']['at'] + 1} has {odd['odd']['cells']} values for {len(head)} columns; a comma in a value has to be inside quotes")
    if not odd["n"]:
        raise ListError("the list has no rows")
    named = {name: i for i, name in enumerate(head)}  # of two columns of a name the last wins
    return numbered(body, "path", "at").select("number", *[F.col("cells")[i].alias(n) for n, i in named.items()])


#: Rows of a report's file at most; what reads a list holds a file at a time.
ROWS = 100_000


def write_report(df: DataFrame, path: str, rows: int = ROWS) -> None:
    """A report as CSV with a header, quotes only where a cell needs them, LF line ends, empty texts empty; in files of so
    many rows at most, whose names are in order."""
    df.write.mode("errorifexists").option("header", True).option("maxRecordsPerFile", rows).option("quote", '"').option("escape", '"').option("emptyValue", "").option("lineSep", "\n").csv(path)


def read_log(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Entries of a JSON-lines log; blank and damaged lines are left out, and entries without a required field."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.na.drop(subset=required)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
