"""Templates with `{column}` in them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(template: str) -> list[tuple[str, bool]]:
    """(text, whether it is a name): from each `{` to the next `}` is a name; a `{` without one ends the scan."""
    out, rest = [], template
    while "{" in rest:
        before, after = rest.split("{", 1)
        if "}" not in after:
            break
        name, rest = after.split("}", 1)
        out += [(before, False), (name, True)]
    # The last `rest` still holds what follows the last name, an open `{` included.
    return [*out, (rest, False)]


def fill(template: str, columns: Iterable[str], number: str = "number") -> Column:
    """The template filled from a row: a column wins over the row's number; unknown names stay as they are written.
    Values are not filled again. The template is taken apart here, so the plan is one concatenation."""
    known = set(columns)
    pieces = []
    for text, is_name in parts(template):
        if is_name and text in known:
            pieces.append(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
        elif is_name and text == "number":
            pieces.append(F.col(number).cast("string"))
        else:
            pieces.append(F.lit("{" + text + "}" if is_name else text))
    return F.concat(*pieces)


def unknown_columns(templates: Iterable[str], df: DataFrame, ignored: Iterable[str] = ("number",)) -> list[str]:
    """Names in templates that are neither columns nor ignored, each once, in order; found before any job runs."""
    known = {*df.columns, *ignored}
    return list(dict.fromkeys(t for template in templates for t, is_name in parts(template) if is_name and t not in known))


def unknown_in(df: DataFrame, template: str, order: str, known: Iterable[str]) -> DataFrame:
    """(name, templates, first): names in templates that are rows which are neither columns nor otherwise known, with the
    number of templates that have each and the first of these."""
    named = df.select(F.col(order).alias("at"), F.explode(F.array_except(placeholders(F.col(template)), F.array(*[F.lit(k) for k in known]))).alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("templates"), F.min("at").alias("first"))


def placeholders(template: Column) -> Column:
    """Names in a template, each once; none that is empty or has a `{`."""
    return F.filter(F.array_distinct(F.regexp_extract_all(template, F.lit("[{]([^}]*)[}]"))), lambda x: (x != "") & ~F.contains(x, F.lit("{")))


def missing(template: Column, given: Column) -> Column:
    """Names in a template that a map hasn't got."""
    return F.array_except(placeholders(template), F.map_keys(given))


def builtin(at: Column) -> dict[str, Column]:
    """today, date, year, month, day of a time."""
    day = F.date_format(at, "yyyy-MM-dd")
    return {"today": day, "date": day, "year": F.date_format(at, "yyyy"), "month": F.date_format(at, "MM"), "day": F.date_format(at, "dd")}


def field_spec(spec: str) -> dict[str, object]:
    """`Name[=Label]` and any of `/below`, `/after`, `/number`, taken off from the right: of places the leftmost wins."""
    place, number = "after", False
    while m := re.search(r"/(below|after|number)\s*$", spec):
        spec = spec[: m.start()]
        place, number = (place, True) if m[1] == "number" else (m[1], number)
    name, _, label = spec.partition("=")
    if not name.strip():
        raise ValueError("a field needs a name")
    return {"name": name.strip(), "label": (label or name).strip(), "place": place, "number": number}
