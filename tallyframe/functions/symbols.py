"""Code 128: the values of a text's symbol, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start of sets B and C, changes to them, the end, and the number that checks are taken by.
START_B, START_C, TO_C, TO_B, STOP, BY = 104, 105, 99, 100, 106, 103


def checksum(start: Column, values: Column) -> Column:
    """The start plus each value times its place, modulo 103."""
    total = F.aggregate(F.transform(values, lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.pmod(start + total, F.lit(BY)).cast("int")


def pieces(text: Column) -> Column:
    """A text cut into runs of an even number of figures that are worth set C (four or more), and what is between.

    An odd figure stays with what stands before the run.
    """
    return F.regexp_extract_all(text, F.lit(r"(?<![0-9])(?:[0-9]{2}){2,}(?![0-9])|(?<=[0-9])(?<![0-9]{2})(?:[0-9]{2}){2,}(?![0-9])|(?s:.)"), F.lit(0))


def code128(text: Column) -> Column:
    """Start, values, check and stop of a text of printable ASCII; null for any other."""
    # A run for set C gives its change, its pairs, and the change back; a single character its value in set B.
    runs = F.transform(pieces(text), lambda p: F.when(F.length(p) > 1, F.concat(F.array(F.lit(TO_C)), F.transform(F.regexp_extract_all(p, F.lit("[0-9]{2}"), F.lit(0)), lambda x: x.cast("int")), F.array(F.lit(TO_B)))).otherwise(F.array(F.ascii(p) - 32)))
    flat = F.flatten(runs)
    begins_c = F.element_at(flat, 1) == TO_C
    # The first change is the start itself, and one at the very end is not needed.
    body = F.when(begins_c, F.slice(flat, 2, F.greatest(F.size(flat) - 1, F.lit(0)))).otherwise(flat)
    body = F.when((F.element_at(body, -1) == TO_B) & (F.length(F.element_at(pieces(text), -1)) > 1), F.slice(body, 1, F.size(body) - 1)).otherwise(body)
    start = F.when(begins_c, START_C).otherwise(START_B)
    return F.when(text.rlike(r"\A[ -~]+\z"), F.concat(F.array(start), body, F.array(checksum(start, body)), F.array(F.lit(STOP))))
