"""Small judgements about places, pages, recipes, stock and bundles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First and last code points of blocks that exist to write about text, or to draw with; and private use.
SPECIALIST = (
    (0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD), (0x0250, 0x02AF), (0x02B0, 0x02FF), (0x1D00, 0x1DBF), (0x2070, 0x209F), (0x2100, 0x214F),
    (0x2150, 0x218F), (0x2190, 0x21FF), (0x2500, 0x257F), (0x2580, 0x259F), (0x25A0, 0x25FF), (0x2600, 0x27BF), (0x2C60, 0x2C7F), (0xA700, 0xA71F),
    (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFF00, 0xFFEF), (0x1D400, 0x1D7FF), (0x1F000, 0x1F0FF), (0x1F100, 0x1F1FF),
)

#: Bytes of pictures held at once at most, and the coarsest drawing worth suggesting, in dots an inch.
MOST_MEMORY, LEAST_DPI = 3 << 29, 50


def anchor_place(text: Column) -> Column:
    """Where something goes from an anchor: after, below or below-end; null for anything else."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("after", "below", "below-end"), word).when(word == "belowend", "below-end")


def on_paper(x: Column, y: Column, width: Column, height: Column, margin: float) -> Column:
    """Whether a place on a page is paper to be looked at: not within the margin of an edge."""
    return (x >= margin) & (y >= margin) & (x <= width - margin) & (y <= height - margin)


def alphabet(common: Column, covered: Column) -> Column:
    """The characters to look for: the common ones that a face covers, then the others it covers, in their order and each
    once; no control characters, white space or specialist notation among these."""
    inside = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SPECIALIST)
    shown = F.filter(covered, lambda c: ~c.rlike(rf"^[\p{{Cc}}\p{{IsWhite_Space}}{inside}]$"))
    return F.array_union(F.filter(common, lambda c: F.array_contains(covered, c)), shown)


def described(names: Column) -> Column:
    """Column names for a message, as they stand in templates; blank ones hidden."""
    return F.array_join(F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(F.lit("{"), n, F.lit("}"))), ", ")


def asks_nothing(*lists: Column) -> Column:
    """Whether all of a recipe's, or a bundle's, lists are empty or missing."""
    return F.greatest(*[F.coalesce(F.size(x), F.lit(0)) for x in lists], F.lit(0)) == 0


def taken_up(count: Column, size: Column, gap: Column) -> Column:
    """What labels side by side and the gaps between them take up."""
    return count * size + F.greatest(count - 1, F.lit(0)) * gap


def listed(code: Column, paper: Column, what_for: Column) -> Column:
    """A line about a stock: its code filled up to eight characters, its paper and its use."""
    return F.concat(F.when(F.length(code) < 8, F.rpad(code, 8, " ")).otherwise(code), F.lit(" "), paper, F.lit(" — "), what_for)


def suggested_dpi(total: Column, dpi: Column) -> Column:
    """Null where pictures of so many bytes fit; else the dots an inch that would, down to a multiple of ten, which memory
    follows as a square."""
    return F.when(total > MOST_MEMORY, F.greatest(F.floor(dpi * F.sqrt(MOST_MEMORY / total) / 10) * 10, F.lit(LEAST_DPI)))
