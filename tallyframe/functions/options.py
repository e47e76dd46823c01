"""What can be tuned, with its defaults and bounds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    """Fixed values as defaults: grey level of ink, tolerance and group in mm, least region in mm2, padding and margin in
    mm, dots an inch."""

    threshold: int = 200
    tolerance: float = 0.12
    group: float = 2.0
    least: float = 0.05
    pad: float = 0.3
    margin: float = 5.0
    dpi: float = 400.0

    def checked(self) -> Options:
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} is from {low} to {high}")
        return self

    def over(self, **given: object) -> Options:
        """These options with what is given in their place; None gives nothing."""
        known = {f.name for f in fields(self)}
        if unknown := set(given) - known:
            raise ValueError(f"no such options: {', '.join(sorted(unknown))}")
        return replace(self, **{k: v for k, v in given.items() if v is not None}).checked()


#: The bounds of each option.
BOUNDS = {"threshold": (1, 255), "tolerance": (0, 25), "group": (0, 100), "least": (0, 1e6), "pad": (0, 100), "margin": (0, 500), "dpi": (36, 2400)}


def laid_over(runs: DataFrame, layers: list[str]) -> DataFrame:
    """Add each option by its name to rows that have some of them in columns with the layers' prefixes, the first layer on
    top of the second and so on, the defaults below all; and `refused`, the first option that is out of its bounds."""
    held = set(runs.columns)
    values = {name: F.coalesce(*[F.col(f"`{layer}{name}`").cast("double") for layer in layers if f"{layer}{name}" in held], F.lit(float(getattr(Options(), name)))) for name in BOUNDS}
    refused = F.coalesce(*[F.when(~values[name].between(low, high), name) for name, (low, high) in BOUNDS.items()])
    return runs.select(*[F.col(f"`{c}`") for c in runs.columns], *[v.alias(name) for name, v in values.items()], refused.alias("refused"))


def field_of(spec: Column) -> Column:
    """(name, label, place, is_number) of `Name[=Label]` and any run of suffixes /below, /after, /number, of which the first
    place counts; a field without a label is looked for by its name."""
    suffixes = F.regexp_extract(spec, r"((?:\s*/(?:below|after|number))*)\s*$", 1)
    plain = F.trim(F.left(F.rtrim(spec), F.char_length(F.rtrim(spec)) - F.char_length(suffixes)))
    equals = F.instr(plain, "=")
    name = F.trim(F.when(equals > 0, F.left(plain, equals - 1)).otherwise(plain))
    label = F.trim(F.when(equals > 0, F.substr(plain, equals + 1)).otherwise(plain))
    place = F.regexp_extract(suffixes, "/(below|after)", 1)
    return F.struct(name.alias("name"), F.when(label == "", name).otherwise(label).alias("label"), F.when(place == "", "after").otherwise(place).alias("place"), F.contains(suffixes, F.lit("/number")).alias("is_number"))


def attempted(column: Column, work: Callable[[str], list[float]]) -> Column:
    """(value, error) of a function of each text: what fails stays as a row that says why."""

    @F.pandas_udf("value array<double>, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((work(t), None))
            except Exception as e:  # noqa: BLE001  # whatever it is, it is told
                out.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(out, columns=["value", "error"])

    return run(column)


def duration(seconds: Column) -> Column:
    """Seconds in words: whole seconds below 90, minutes below 90 of them, else hours and minutes."""
    s = F.round(seconds).cast("long")
    minutes = F.round(s / 60).cast("long")
    hours = F.floor(minutes / 60)
    return F.when(s < 90, F.concat(s.cast("string"), F.lit(" s"))).when(minutes < 90, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(hours.cast("string"), F.lit(" h "), (minutes - hours * 60).cast("string"), F.lit(" min")))


def saved_document(content: Column, schema: str) -> tuple[Column, Column]:
    """(document, fault) of a JSON document's bytes: what kind of file it is instead, or that it is damaged."""
    text = content.cast("string")
    parsed = F.from_json(text, schema)
    start = F.hex(F.substring(content, 1, 4))
    fault = (
        F.when(F.octet_length(content) == 0, "empty").when(start == "25504446", "a PDF").when(start == "504B0304", "a zip file").when(start == "89504E47", "a picture")
        .when(~F.is_valid_utf8(text), "no text").when(F.json_array_length(text).isNotNull() | F.json_object_keys(text).isNull(), "damaged")
    )
    return F.when(fault.isNull(), parsed), fault
