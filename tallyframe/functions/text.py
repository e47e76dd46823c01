"""Text: normal forms, bounded distances, repairs of misread figures, shortening, escaping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are taken for digits, and the digits.
MISREAD, DIGITS = "OolIiSsZzBbGg", "0011155228866"

#: A number as text, once currency signs, separators and spaces are gone.
NUMBER = r"^[+-]?((?i)inf|infinity|nan|([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)$"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")


def squash(text: Column) -> Column:
    """Letters and figures only, lower-cased."""
    return F.lower(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}]", ""))


def squash_space(text: Column) -> Column:
    """Without white space, lower-cased."""
    return F.lower(F.regexp_replace(text, r"[\p{IsWhite_Space}]", ""))


def shape(text: Column) -> Column:
    """The squashed text with figures folded into the letters they look like."""
    return F.translate(squash(text), "0i15286", "ollszbg")


def budget(key: Column) -> Column:
    """Errors that a key of this length may have: none below five letters, else a quarter."""
    return F.when(F.length(key) < 5, 0).otherwise(F.floor(F.length(key) / 4)).cast("int")


def within(found: Column, wanted: Column, errors: int) -> Column:
    """Whether two keys differ by at most `errors` edits."""
    return F.levenshtein(found, wanted, errors) >= 0 if errors else found == wanted


def within_budget(found: Column, wanted: Column) -> Column:
    """Whether two keys differ by at most the wanted key's budget."""
    return F.levenshtein(found, wanted) <= budget(wanted)


def plain_number(text: Column) -> Column:
    """The text without what may stand around figures."""
    return F.translate(text, ", () £$€¥%", "")


def is_number(text: Column) -> Column:
    """Whether the text reads as a number; by a pattern, as casts take more and less."""
    return plain_number(text).rlike(NUMBER)


def repair_digits(text: Column) -> Column:
    """Words with a figure that are else made of letters like figures, as figures; other words stay."""
    plain = lambda w: F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}]", "")
    fixed = F.transform(F.split(text, " "), lambda w: F.when(plain(w).rlike("^[0-9OolIi]*[0-9][0-9OolIi]*$"), F.translate(w, "OolIi", "00111")).otherwise(w))
    return F.array_join(fixed, " ")


def insisted_number(text: Column) -> tuple[Column, Column]:
    """(text, status): the text with misread characters as figures if that is a number, else the text as it is."""
    repaired = F.translate(text, MISREAD, DIGITS)
    good = is_number(repaired)
    return F.when(good, repaired).otherwise(text), F.when(text == "", "Blank").when(good, "Read").otherwise("NotANumber")


def shorten_tail(text: Column, most: int) -> Column:
    """The end of a text that is too long, behind an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(most - 1))))


def shorten_head(text: Column, most: int) -> Column:
    """The beginning of a text that is too long, before an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 1)), F.lit("…")))


def one_line(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for plain, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def safe_name(text: Column, fallback: str) -> Column:
    """A text that can be a file's name: other characters as dashes; a fallback if none is left."""
    kept = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    return F.when(kept == "", F.lit(fallback)).otherwise(kept)


def valid_name(text: Column) -> Column:
    """Whether a text names a series, job or profile."""
    return text.rlike(r"\A[A-Za-z0-9_-]{1,64}\z")


#: Scripts by ranges of code points, in order; characters at home in any of them; what runs from right to left.
SCRIPTS = {
    "Latin": ((0x0041, 0x024F), (0x1E00, 0x1EFF), (0xA720, 0xA7FF)),
    "Greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x0400, 0x052F),),
    "Hebrew": ((0x0590, 0x05FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "Devanagari": ((0x0900, 0x097F),),
    "Thai": ((0x0E00, 0x0E7F),),
    "Lao": ((0x0E80, 0x0EFF),),
    "Han": ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "Hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
}
COMMON = ((0x21, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0x2000, 0x206F), (0x20A0, 0x20CF), (0x2190, 0x2BFF))
RIGHT_TO_LEFT = ((0x0590, 0x08FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF), (0x10800, 0x10FFF), (0x1E800, 0x1EFFF))
BLANK = ((0x00, 0x20), (0x7F, 0xA0), (0x2000, 0x200B), (0x3000, 0x3000))


def points(*ranges: tuple[int, int]) -> str:
    """The inside of a pattern's class."""
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def how_many(text: Column, inside: str) -> Column:
    """Characters of a class, by what is left without them."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{inside}]+", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def script_counts(text: Column) -> Column:
    """(n, place, script) of each script that a whole text has letters of: those listed, and one for each 128 code points
    elsewhere. What is at home anywhere, blanks and controls count for none. A script's letters are taken out before the
    next one's are looked for, so most letters are read once or twice."""

    def elsewhere(piles: Column) -> Column:
        return F.transform(F.array_distinct(piles), lambda p: F.struct(F.size(F.filter(piles, lambda q: q == p)).cast("long").alias("n"), (-100 - p).cast("long").alias("place"), F.concat(F.lit("Elsewhere "), p.cast("string")).alias("script")))

    def counted(left: Column, found: list[Column], scripts: list) -> Column:
        if not scripts:
            piles = F.transform(F.regexp_extract_all(left, F.lit("(?s)."), 0), lambda c: F.shiftright(F.ascii(c), 7))
            return let(piles, lambda p: F.filter(F.concat(F.array(*found), elsewhere(p)), lambda s: s["n"] > 0))
        (i, (name, ranges)), *others = scripts

        def taken(less: Column) -> Column:
            own = F.struct((F.char_length(left) - F.char_length(less)).cast("long").alias("n"), F.lit(-i).cast("long").alias("place"), F.lit(name).alias("script"))
            return counted(less, [*found, own], others)

        return let(F.regexp_replace(left, f"[{points(*ranges)}]+", ""), taken)

    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{points(*COMMON, *BLANK)}]+", "")
    return let(bare, lambda b: counted(b, [], list(enumerate(SCRIPTS.items()))))


def script(text: Column) -> Column:
    """The script that most letters of a whole text are of; of equals the first listed; Common without letters."""
    return F.coalesce(F.array_max(script_counts(text))["script"], F.lit("Common"))


def as_read(line: Column) -> Column:
    """A line that was found from left to right as it is read: where more letters run from right to left than do not, its
    words, and the letters in them, are turned round."""
    leftward = how_many(line, points(*RIGHT_TO_LEFT))
    letters = how_many(F.regexp_replace(line, f"[{points(*RIGHT_TO_LEFT)}]+", ""), r"\p{IsAlphabetic}")
    return F.when(leftward > letters, F.array_join(F.transform(F.reverse(F.split(line, " ")), F.reverse), " ")).otherwise(line)


def common_run(a: Column, b: Column) -> Column:
    """Length of the longest run of characters that both texts have, however long; 0 for a null. Windows of shorter
    lengths meet wherever longer ones do, so the longest length whose windows meet is found by halving."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    windows = lambda t, n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, n))
    most = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(most + 1)).cast("int"))

    def halve(held: Column, _: Column) -> Column:
        n = F.shiftright(held["low"] + held["high"] + 1, 1)
        meet = F.arrays_overlap(windows(a, n), windows(b, n))
        return F.struct(F.when(meet, n).otherwise(held["low"]).alias("low"), F.when(meet, held["high"]).otherwise(n - 1).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), most.alias("high")), halve, lambda held: held["low"])


def wrapped(text: Column, width: int) -> Column:
    """Lines of whole words of at most `width` characters, greedily; a word that is too long has a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(held: Column, word: Column) -> Column:
        longer = F.concat_ws(" ", F.nullif(held["line"], F.lit("")), word)
        fits = (held["line"] == "") | (F.length(longer) <= width)
        return F.when(fits, F.struct(held["lines"].alias("lines"), longer.alias("line"))).otherwise(F.struct(F.array_append(held["lines"], held["line"]).alias("lines"), word.alias("line")))

    return F.aggregate(words, start, step, lambda held: F.when(held["line"] == "", held["lines"]).otherwise(F.array_append(held["lines"], held["line"])))
