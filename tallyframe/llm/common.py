"""What the operators of this package share: batches of text, columns, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.tables import Temporary, forget, shared_folder, written  # noqa: F401  # used by the other modules from here

#: A word: a run of anything but the six ASCII white-space characters. `bytes.split()` splits alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one step of a Python worker holds at a time (a longer text is a step of its own).
PIECE_BYTES = 2 << 20

#: Bytes in an Arrow batch between the JVM and Python.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows: a few thousand very long texts would not fit a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int("".join(c for c in spark.conf.get(key) if c.isdigit()))
    if held > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def training_row(id_col: Column, folds: int, held: int = 1) -> Column:
    """True where crc32 of the id as text, modulo `folds`, is not `held`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds != held


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` without columns that are called like a result; names differ by more than case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of `df` begins with, in any case of letters."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns c0, c1, ..., which no name of ours is like, and what each column is called there."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def pieces(texts: list[bytes], most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about `most` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as the empty text."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [t or b"" for t in column.to_pylist()]


def map_texts(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list[bytes]], dict[str, object]]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    binary: bool = False,
    piece: int = PIECE_BYTES,
) -> DataFrame:
    """Add `fields` to each row, computed from its whole text; one row out for each row in.

    `make()` is called once a task and returns a function from some texts (null: empty) to one list or array a
    field. `text_col` is cast to text, or taken as bytes if `binary`; `piece` bounds
    the bytes of texts given at a time (a longer text comes alone). `keep` names the columns that are returned besides (default: all, but for those called like a field).
    """
    bounded_batches(df.sparkSession)
    names = [f.name for f in fields]
    kept = without(df, names).columns if keep is None else keep
    schema = T.StructType([*[f for f in df.select(*[F.col(f"`{c}`") for c in kept]).schema], *fields])
    sent = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").cast("binary" if binary else "string").alias("text"))
    types = [f.dataType for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        compute, arrow = make(), [to_arrow_type(t) for t in types]
        for batch in batches:
            texts = as_bytes(batch.column(batch.num_columns - 1))
            for a, b in pieces(texts, piece):
                got = compute(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(kept))), *(pa.array(got[n], type=t) for n, t in zip(names, arrow, strict=True))],
                    names=[*kept, *names],
                )

    return sent.mapInArrow(run, schema)


def joined(texts: list[bytes], gap: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by `gap` zero bytes; where each starts and ends."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(lengths[:-1] + gap, out=starts[1:])
    filler = b"\0" * gap
    return np.frombuffer(filler.join([*texts, b""]), dtype=np.uint8), starts, starts + lengths


def alike(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of a sorted batch that are alike in some columns of whole numbers."""
    if not batch.num_rows:
        return
    keys = [batch.column(c).to_numpy() for c in columns]
    edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
        yield tuple(int(k[a]) for k in keys), batch.slice(a, b - a)
