"""Folders, file names, and safe writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of files that are still being written, of pictures, and of documents that can be read.
UNFINISHED = ("part", "crdownload", "tmp", "partial", "download")
PICTURES = ("png", "jpg", "jpeg", "gif", "tif", "tiff", "bmp", "webp")
READABLE = ("pdf", "docx", "odt", "fodt", "txt", "md", "csv", "xlsx", "ods")


def why_not(name: Column, own_tail: str = "-delta.pdf") -> Column:
    """Why a file isn't looked at, by the first reason that holds; null if it is. The order of reasons matters."""
    low = F.lower(name)
    ending = F.regexp_extract(low, r"[.]([^.]*)$", 1)
    return (
        F.when(name.startswith(".") | name.startswith("~$"), "hidden").when(ending.isin(*UNFINISHED), "unfinished").when(ending == "", "no ending")
        .when(F.endswith(low, F.lit(own_tail)), "own output").when(ending.isin(*PICTURES), "picture").when(~ending.isin(*READABLE), "unknown kind")
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified) of a folder's own files; contents aren't read."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified"))


def kind_by_content(content: Column) -> Column:
    """What a file is by its first bytes, whatever it is called."""
    start = lambda n: F.hex(F.substring(content, 1, n))
    return F.when(start(4) == "504B0304", "zip").when(start(5) == "255044462D", "pdf").when(start(8) == "89504E470D0A1A0A", "picture").when(start(3) == "FFD8FF", "picture").when(F.is_valid_utf8(content.cast("string")), "text").otherwise("unknown")


def documents_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, text) of a folder's files; text is null for what isn't UTF-8 text."""
    files = spark.read.format("binaryFile").load(folder).withColumn("kind", kind_by_content(F.col("content")))
    return files.select("path", "kind", F.when(F.col("kind") == "text", F.col("content").cast("string")).alias("text"))


def refuse_to_clobber(out: str, inputs: list[str]) -> None:
    """Raise if a result would overwrite what it is made from."""
    norm = lambda p: p.rstrip("/").removeprefix("file:").replace("//", "/")
    if norm(out) in {norm(i) for i in inputs}:
        raise ValueError(f"{out} is an input")
