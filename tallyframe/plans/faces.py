"""Typefaces, pictures a cell off, and targets, over the standard tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from tallyframe.functions import faces, measure
from tallyframe.operators import faces as pages
from tallyframe.operators import fits
from tallyframe.plans.registry import query, table

#: The printable ASCII characters.
ASCII = "".join(map(chr, range(0x20, 0x7F)))

#: Widths of the printable ASCII characters in thousandths of the size, from the space on.
SANS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
SERIF = (
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
    921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
    333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
)

#: Characters beyond ASCII that are no letters with a mark.
BEYOND = "€‚ƒ„…†‡ˆ‰‹Œ‘’“”•–—˜™›œ\u00a0¡¢£¤¥¦§¨©ª«¬\u00ad®¯°±²³´µ¶·¸¹º»¼½¾¿ÆÐ×ØÞßæð÷øþ"

#: Their widths, in the same order.
SANS_BEYOND = (
    556, 222, 556, 333, 1000, 556, 556, 333, 1000, 333, 1000, 222, 222, 333, 333, 350, 556, 1000, 333, 1000, 333, 944,
    278, 333, 556, 556, 556, 556, 260, 556, 333, 737, 370, 556, 584, 333, 737, 333, 400, 584, 333, 333, 333, 556, 537, 278, 333, 333, 365, 556, 834, 834, 834, 611,
    1000, 722, 584, 778, 667, 611, 889, 556, 584, 611, 556,
)
SERIF_BEYOND = (
    500, 333, 500, 444, 1000, 500, 500, 333, 1000, 333, 889, 333, 333, 444, 444, 350, 500, 1000, 333, 980, 333, 722,
    250, 333, 500, 500, 500, 500, 200, 500, 333, 760, 276, 500, 564, 333, 760, 333, 400, 564, 300, 300, 333, 500, 453, 250, 333, 300, 310, 500, 750, 750, 750, 444,
    889, 722, 564, 722, 556, 500, 667, 500, 564, 500, 500,
)


def widths(ascii_: tuple[int, ...], beyond: tuple[int, ...], dotless: int) -> dict[str, int]:
    """All characters that the faces' encoding has: a letter with a mark is as wide as without it, but for the i, which
    loses its dot."""
    out = dict(zip(ASCII, ascii_, strict=True)) | dict(zip(BEYOND, beyond, strict=True))
    every = [bytes([code]).decode("cp1252", "ignore") for code in range(0x80, 0x100)]
    return out | {c: dotless if c in "ìíîï" else out[unicodedata.normalize("NFD", c)[0]] for c in every if c and c not in out}


FACES = {"Sans": widths(SANS, SANS_BEYOND, 278), "Serif": widths(SERIF, SERIF_BEYOND, 278), "Mono": dict.fromkeys(ASCII + BEYOND, 600)}
FACES["Mono"] |= dict.fromkeys(FACES["Sans"], 600)

SAID = "SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' €→→λ' WHEN 1 THEN chr(9) || '„…“' WHEN 2 THEN chr(7) ELSE '' END AS t FROM documents"

EXTRA = "".join(faces.EXTRA.values())


@query(
    "writable",
    f"""WITH s AS (SELECT doc_id, replace(replace(replace(t, chr(9), ' '), chr(13), ''), chr(10), '') AS t FROM ({SAID})),
          m AS (SELECT doc_id, t, list_distinct(regexp_extract_all(t, '[^ -~\\x{{A0}}-\\x{{FF}}{EXTRA}]')) AS missing, regexp_matches(t, '[\\x00-\\x1F\\x7F]') AS control FROM s)
        SELECT doc_id, CASE WHEN control THEN 'Control' WHEN len(missing) > 0 THEN 'Missing' ELSE 'Encoded' END AS status, array_to_string(list_sort(missing), '') AS missing,
               CASE WHEN NOT control AND len(missing) = 0 THEN length(t) END AS n_bytes FROM m""",
)
def writable(spark, d):
    k = F.col("doc_id") % 4
    more = F.when(k == 0, " €→→λ").when(k == 1, "\t„…“").when(k == 2, "\x07").otherwise("")
    text = F.concat("text", more)
    status, codes = faces.encoded(text)
    return table(spark, d, "documents").select("doc_id", status.alias("status"), F.array_join(F.array_sort(faces.missing(text)), "").alias("missing"), F.octet_length(codes).cast("long").alias("n_bytes"))


@query(
    "text_widths",
    """WITH w AS (SELECT map(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i', 'j', 'k', 'l', 'm', 'n', 'o', 'p', 'q', 'r', 's', 't', 'u', 'v', 'w', 'x', 'y', 'z'],
                             [556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500]) AS m)
       SELECT p_partkey, round((list_sum(list_transform(string_split(p_name, ''), lambda c: CASE c WHEN ' ' THEN 278 ELSE m[c] END)) + 278 + 333 + 667 + 333 + 556 + 556 + 556 + 556 + 556 * (length(p_brand) - 6) + 333 + 278 + 556 + 278 + 278 + 1000 + 191 + 556) / 1000.0::DOUBLE * 12 * 25.4::DOUBLE / 72, 6) AS width FROM part, w""",
)
def text_widths(spark, d):
    """Names, brands in brackets (`Brand#` and figures), a dash, a tab, and letters with marks; what has no glyph counts nothing."""
    said = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")\t–\tî—'é→\n"))
    return table(spark, d, "part").select("p_partkey", F.round(faces.width_mm(said, FACES["Sans"], 12.0), 6).alias("width"))


@query("typefaces")
def typefaces(spark, d):
    """Each page is the names of a brand's parts, set in one of three faces at 10 to 12 pt, with some measuring error."""
    words = pages.spread(table(spark, d, "part").select("p_brand", "p_partkey", F.explode(F.split("p_name", " ")).alias("text")))
    no = F.pmod(F.xxhash64("p_brand"), F.lit(3)).cast("int")
    set_in = F.array(*[faces.width_mm(F.col("text"), FACES[n], 1.0) for n in FACES])[no]
    words = words.select("p_brand", "text", (set_in * (no + 10) + F.col("p_partkey") % 7 / 500).alias("width"))
    got = pages.typefaces(words, "p_brand", FACES)
    return got.select("p_brand", "face", F.round("size_pt", 2).alias("size_pt"), F.round("confidence", 3).alias("confidence"), "words")


@query(
    "best_jaccard",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
          s AS (SELECT vec_id, dx, dy, sum(least(a[i + 1], b)) / sum(greatest(a[i + 1], b)) AS j
                FROM (SELECT vec_id, dx, dy, i, a, CASE WHEN i % 8 - dx BETWEEN 0 AND 7 AND i // 8 - dy BETWEEN 0 AND 7 THEN b[(i - dy * 8 - dx + 1)::BIGINT] ELSE 0 END AS b
                      FROM p, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy), range(64) r(i)) GROUP BY ALL)
       SELECT vec_id, round(max(j), 6) AS score FROM s GROUP BY vec_id""",
)
def best_jaccard(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("a"))
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return e.join(following, "vec_id").select("vec_id", F.round(measure.best_jaccard(F.col("a"), F.col("b"), 8), 6).alias("score"))


@query(
    "fiducials",
    """WITH s AS (SELECT p_partkey, p_size * 6.0::DOUBLE AS w, p_size * 5.0::DOUBLE + 20 AS h FROM part), i AS (SELECT *, greatest(15.0, least(25.0, least(w, h) / 4))::DOUBLE AS i FROM s)
       SELECT p_partkey, place, CASE place WHEN 0 THEN i WHEN 1 THEN w - i WHEN 2 THEN i WHEN 3 THEN w - i ELSE w / 2 END AS x, CASE place WHEN 0 THEN i WHEN 1 THEN i WHEN 2 THEN h - i WHEN 3 THEN h - i ELSE h / 2 END AS y FROM i, range(5) r(place)""",
)
def fiducials(spark, d):
    size = F.col("p_size")
    out = table(spark, d, "part").select("p_partkey", F.posexplode(measure.fiducials(size * 6.0, size * 5.0 + 20)).alias("place", "p"))
    return out.select("p_partkey", F.col("place").cast("long").alias("place"), "p.x", "p.y")


READ = "SELECT s_nationkey AS k, s_suppkey % 200 * 1.0 AS ax, (s_suppkey * 37) % 290 * 1.0 AS ay, s_suppkey % 200 * 1.01 + s_acctbal / 10007 AS bx, ((s_suppkey * 37) % 290) * 1.02 - 1 AS by_ FROM supplier WHERE s_acctbal >= 0"


@query(
    "measured_targets",
    f"""WITH p AS ({READ}), g AS (SELECT k, count(*) AS n, (covar_pop(ax, bx) + covar_pop(ay, by_)) / (var_pop(ax) + var_pop(ay)) AS a, (covar_pop(ax, by_) - covar_pop(ay, bx)) / (var_pop(ax) + var_pop(ay)) AS b FROM p GROUP BY k HAVING count(*) >= 3)
        SELECT k, n, round(degrees(atan2(b, a)), 6) AS rotation, round(sqrt(a * a + b * b), 6) AS scale FROM g""",
)
def measured_targets(spark, d):
    x, y, good = (F.col("s_suppkey") % 200).cast("double"), ((F.col("s_suppkey") * 37) % 290).cast("double"), F.col("s_acctbal") >= 0
    read = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), x.alias("ax"), y.alias("ay"), F.when(good, x * 1.01 + F.col("s_acctbal") / 10007).alias("bx"), F.when(good, y * 1.02 - 1).alias("by_"))
    return fits.measured(read, ["k"], (105.0, 148.5), "ax", "ay", "bx", "by_").select("k", "n", F.round("rotation", 6).alias("rotation"), F.round("scale", 6).alias("scale"))
