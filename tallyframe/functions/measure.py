"""Numbers: units, sizes, slots, vectors, hashes, dates as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Millimetres in an inch, points in an inch.
MM, PT = 25.4, 72.0

#: Named sheets, width and height in millimetres.
SHEETS = (("A3", 297.0, 420.0), ("A4", 210.0, 297.0), ("A5", 148.0, 210.0), ("Letter", 215.9, 279.4), ("Legal", 215.9, 355.6))


def mm_to_pt(mm: Column) -> Column:
    return mm * PT / MM


def pt_to_mm(pt: Column) -> Column:
    return pt * MM / PT


def mm_to_px(mm: Column, dpi: float) -> Column:
    return mm * dpi / MM


def sheet_size(spec: Column) -> Column:
    """(width, height) in mm of a named sheet or `WxH` / `W*H`; null where either is not from 5 to 2000."""
    named = F.lower(F.trim(spec))
    parts = F.split(named, "[x*]")
    width, height = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    good = (F.size(parts) == 2) & width.between(5, 2000) & height.between(5, 2000)
    out = F.when(good, F.struct(width.alias("width"), height.alias("height")))
    for name, w, h in SHEETS:
        out = F.when(named == name.lower(), F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))).otherwise(out)
    return out


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def overlap(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Length that two intervals share over the shorter one's; 0 where either has no length."""
    shorter = F.least(x1 - x0, y1 - y0)
    return F.when(shorter > 0, F.greatest(F.least(x1, y1) - F.greatest(x0, y0), F.lit(0.0)) / shorter).otherwise(0.0)


def colour(text: Column) -> Column:
    """(r, g, b) from 0 to 1 of #rrggbb or #rgb; null for anything else."""
    hexed = F.lower(F.regexp_replace(text, "^#", ""))
    full = F.when(F.length(hexed) == 3, F.regexp_replace(hexed, "(.)", "$1$1")).otherwise(hexed)
    part = lambda at: F.conv(F.substring(full, at, 2), 16, 10).cast("double") / 255
    return F.when(full.rlike("^[0-9a-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def slot(n: Column, skip: int, across: int, down: int) -> tuple[Column, Column, Column]:
    """(sheet, row, column), all from 0, of the n-th label (from 0) when `skip` are used up."""
    at = n + skip
    cell = F.pmod(at, F.lit(across * down))
    return F.floor(at / (across * down)), F.floor(cell / across), F.pmod(cell, F.lit(across))


def sheets_needed(n: Column, skip: int, per_sheet: int) -> Column:
    return F.ceil((n + skip) / per_sheet)


def sheet_and_back(page: Column) -> tuple[Column, Column]:
    """(sheet, whether it is the back) of a page, all from 1; what is below 1 counts as 1."""
    page = F.greatest(page, F.lit(1))
    return F.ceil(page / 2), page % 2 == 0


def sheets_for(pages: Column) -> Column:
    """Sheets that so many pages take, printed on both sides."""
    return F.ceil(pages / 2)


def turned(x: Column, y: Column, rotation: Column, width: Column, height: Column, around: Column) -> Column:
    """(x, y, rotation) of a placement on a page that comes out `around`, upside down, or as it was put in."""
    return F.struct(F.when(around, width - x).otherwise(x).alias("x"), F.when(around, height - y).otherwise(y).alias("y"), F.when(around, rotation + 180).otherwise(rotation).alias("rotation"))


def page_of(sheet: Column, back: Column) -> Column:
    """The page on the front or the back of a sheet, all from 1."""
    return 2 * sheet - 1 + back.cast("int")


def half_l1(a: Column, b: Column) -> Column:
    """Half the sum of differences of two vectors' shares, 0 to 1; infinite where they can't be compared."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    good = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (total(a) > 0) & (total(b) > 0)
    apart = F.aggregate(F.zip_with(shares(a), shares(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2
    return F.when(good, apart).otherwise(F.lit(float("inf")))


def shares(v: Column) -> Column:
    """A vector over its sum; null where that isn't above 0."""
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    once = F.transform(F.array(total), lambda t: F.transform(v, lambda x: x / t))[0]  # not added up again for each element
    return F.when(total > 0, once)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of least over sum of greatest; 0 for empty vectors."""
    both = F.zip_with(a, b, lambda x, y: F.struct(F.least(x, y).alias("l"), F.greatest(x, y).alias("g")))
    low, high = F.aggregate(both, F.lit(0.0), lambda s, x: s + x["l"]), F.aggregate(both, F.lit(0.0), lambda s, x: s + x["g"])
    return F.when(high > 0, low / high).otherwise(0.0)


def moved(v: Column, width: int, dx: int, dy: int) -> Column:
    """A square picture of `width`, row by row, moved right and down; what comes in from outside is 0."""
    x, y = lambda i: i % width, lambda i: i // width
    inside = [0 <= x(i) - dx < width and 0 <= y(i) - dy < width for i in range(width * width)]
    return F.array(*[v[i - dy * width - dx] if held else F.lit(0.0) for i, held in enumerate(inside)])


def best_jaccard(a: Column, b: Column, width: int) -> Column:
    """The highest weighted Jaccard of two square pictures, the second one as it is or a cell off."""
    return F.greatest(*[weighted_jaccard(a, moved(b, width, dx, dy) if dx or dy else b) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])


def fiducials(width: Column, height: Column, inset: Column | None = None) -> Column:
    """(x, y) of the four corner marks and the middle one of a sheet; the inset is a quarter of the shorter side, 15 to
    25 mm, unless given."""
    own = F.greatest(F.lit(15.0), F.least(F.lit(25.0), F.least(width, height) / 4)) if inset is None else inset
    places = [(own, own), (width - own, own), (own, height - own), (width - own, height - own), (width / 2, height / 2)]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in places])


def pooled(v: Column, width: int, block: int) -> Column:
    """Means of square blocks of a square picture of `width`, row by row."""
    n = width // block
    cells = F.sequence(F.lit(0), F.lit(n * n - 1))
    offsets = F.array(*[F.lit(y * width + x) for y in range(block) for x in range(block)])
    first = lambda c: (F.floor(c / n) * block * width + F.pmod(c, F.lit(n)) * block).cast("int")
    return F.transform(cells, lambda c: F.aggregate(offsets, F.lit(0.0), lambda s, o: s + F.element_at(v, first(c) + o + 1)) / float(block * block))


def apply_similarity(x: Column, y: Column, fit: dict[str, Column], centre: tuple[float, float]) -> tuple[Column, Column]:
    """A point turned about the centre, scaled and shifted."""
    angle = F.radians(fit["rotation"])
    ux, uy = x - centre[0], y - centre[1]
    return (
        fit["scale"] * (ux * F.cos(angle) - uy * F.sin(angle)) + centre[0] + fit["dx"],
        fit["scale"] * (ux * F.sin(angle) + uy * F.cos(angle)) + centre[1] + fit["dy"],
    )


def undo_similarity(x: Column, y: Column, fit: dict[str, Column], centre: tuple[float, float]) -> tuple[Column, Column]:
    """The point that `apply_similarity` takes to (x, y)."""
    angle = F.radians(fit["rotation"])
    ux, uy = (x - centre[0] - fit["dx"]) / fit["scale"], (y - centre[1] - fit["dy"]) / fit["scale"]
    return ux * F.cos(angle) + uy * F.sin(angle) + centre[0], uy * F.cos(angle) - ux * F.sin(angle) + centre[1]


def nearness(value: Column, want: Column, tolerance: float) -> Column:
    """1 where a value is as wanted, less the farther it is, by a bell curve."""
    z = (value - want) / tolerance
    return F.exp(-0.5 * z * z)


def relative_age(seconds: Column) -> Column:
    """How long ago in words, by whole units."""
    return (
        F.when(seconds <= 0, "just now").when(seconds <= 90, F.concat(seconds.cast("string"), F.lit(" s ago")))
        .when(seconds <= 5400, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min ago")))
        .when(seconds <= 172_800, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(F.floor(seconds / 86_400).cast("string"), F.lit(" d ago")))
    )


def serial_date(serial: Column, since_1904: bool = False) -> Column:
    """A spreadsheet's day number as text: date, and time where it has one; null where it is no date.

    Counted from 1900 there is a 29 February that never was: days before number 60 are one earlier. Seconds are
    rounded and never carried over.
    """
    day = F.floor(serial)
    seconds = F.round((serial - day) * 86_400).cast("int")
    start = F.lit("1904-01-01").cast("date") if since_1904 else F.when(day < 60, F.lit("1899-12-31").cast("date")).otherwise(F.lit("1899-12-30").cast("date"))
    date = F.date_format(F.date_add(start, day.cast("int")), "yyyy-MM-dd")
    time = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("int"), F.pmod(seconds, F.lit(60)))
    shown = F.when(seconds == 0, date).otherwise(F.concat_ws(" ", date, time))
    shown = shown if since_1904 else F.when(day == 0, time).otherwise(shown)
    return F.when((serial >= 0) & (serial < 2_958_466), shown)


def saturating_add(a: Column, b: Column) -> Column:
    """A sum of whole numbers that stops at the largest one."""
    return F.coalesce(F.try_add(a, b), F.lit((1 << 63) - 1))


def roman(n: Column) -> Column:
    """A number from 1 to 3999 in Roman figures; others are taken to the nearer end."""
    held = F.least(F.greatest(n, F.lit(1)), F.lit(3999))
    out = []
    for ten, five, one, unit in (("", "", "M", 1000), ("M", "D", "C", 100), ("C", "L", "X", 10), ("X", "V", "I", 1)):
        digit = F.pmod(F.floor(held / unit), F.lit(10)).cast("int")
        out.append(F.element_at(F.array(*[F.lit(s) for s in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), digit + 1))
    return F.concat(*out)


def letters(n: Column) -> Column:
    """a to z, then aa, ab and so on, for numbers up to 702."""
    last = F.pmod(n - 1, F.lit(26)).cast("int")
    first = F.floor((n - 1) / 26).cast("int")
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.when(first > 0, F.substr(alphabet, first, F.lit(1))).otherwise(""), F.substr(alphabet, last + 1, F.lit(1)))
