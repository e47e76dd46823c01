"""Text in the built-in typefaces: what they can write, how wide it comes out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import let

#: Characters that the faces' encoding has at 0x80 to 0x9F, by that code.
EXTRA = {code: bytes([code]).decode("cp1252") for code in range(0x80, 0xA0) if bytes([code]).decode("cp1252", "ignore")}

#: A class of all characters that can be written.
WRITABLE = r"\x20-\x7E\xA0-\xFF" + "".join(EXTRA.values())


def measurable(word: Column) -> Column:
    """Whether a word's width says something: two characters or more, letters and figures only, and all in the faces."""
    return word.rlike(r"^[\p{IsAlphabetic}\p{N}]{2,}$") & ~word.rlike(f"[^{WRITABLE}]")


def shown(text: Column) -> Column:
    """Tabs as spaces, without ends of lines."""
    for mark, instead in (("\t", " "), ("\r", ""), ("\n", "")):
        text = F.replace(text, F.lit(mark), F.lit(instead))
    return text


def unusual(plain: Column) -> Column:
    """What is left of a text without the characters of most texts, which two ranges hold."""
    return F.regexp_replace(plain, r"[\x20-\x7E\xA0-\xFF]+", "")


def missing(text: Column) -> Column:
    """The distinct characters that the faces haven't got, in the order of the text."""
    return F.array_distinct(F.regexp_extract_all(unusual(shown(text)), F.lit(f"[^{WRITABLE}]"), F.lit(0)))


def encoded(text: Column) -> tuple[Column, Column]:
    """(status, bytes): Control if the text has a control character, Missing if it has one without a glyph, else
    Encoded; bytes only then. A null text has a null status."""
    extra = "".join(EXTRA.values())

    def codes(plain: Column, rest: Column, status: Column) -> Column:
        as_codes = F.when(rest.rlike(f"[{extra}]"), F.translate(plain, extra, "".join(map(chr, EXTRA)))).otherwise(plain)
        return F.struct(status.alias("status"), F.when(status == "Encoded", F.encode(as_codes, "ISO-8859-1")).alias("codes"))

    def told(plain: Column, rest: Column) -> Column:
        bad = F.when(rest.rlike(r"[\x00-\x1F\x7F]"), "Control").when(rest.rlike(f"[^{WRITABLE}]"), "Missing")
        return let(bad.when(plain.isNotNull(), "Encoded"), lambda status: codes(plain, rest, status))

    both = let(shown(text), lambda plain: let(unusual(plain), lambda rest: told(plain, rest)))
    return both["status"], both["codes"]


def by_width(widths: Mapping[str, int]) -> dict[int, str]:
    """A class of characters for each width."""
    out: dict[int, str] = {}
    for char, width in widths.items():
        out[width] = out.get(width, "") + (char if char.isalnum() else "\\" + char)
    return out


def width_mm(text: Column, widths: Mapping[str, int], size_pt: float) -> Column:
    """Width of a text in a face whose characters are so many thousandths of the size wide; others count nothing. Each
    character is turned into the one whose code is its width, in one pass; widths that are no such code are counted."""
    coded = {char: width for char, width in widths.items() if 0 < width < 0xD800}
    plain = shown(text)
    counts = [F.regexp_count(plain, F.lit(f"[{chars}]")) * width for width, chars in sorted(by_width({c: w for c, w in widths.items() if c not in coded}).items())]
    if coded:
        known = F.regexp_replace(plain, f"[^{''.join(by_width(coded).values())}]", "")
        codes = F.split(F.translate(known, "".join(coded), "".join(map(chr, coded.values()))), "")
        counts.append(F.aggregate(codes, F.lit(0), lambda total, c: total + F.ascii(c)))
    return sum(counts, F.lit(0)) / 1000.0 * size_pt * 25.4 / 72.0
