"""Finding phrases and labelled values in placed words.

Words are rows (sheet, line, word_no, text, x, y, w, h); lines are told apart by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import squash, within


def placed_words(df: DataFrame, sheet: str, text: str, line_height: float = 5.0, letter: float = 2.0) -> DataFrame:
    """Words of texts as if set in letters of one width, line under line."""
    lines = df.select(F.col(sheet).alias("sheet"), F.posexplode(F.split(text, "\n")).alias("line", "said"))
    # Where a word starts follows from the length of what stands before it.
    words = lines.select("sheet", "line", F.posexplode(F.split("said", " ")).alias("word_no", "text"), "said")
    before = Window.partitionBy("sheet", "line").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    x = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)) * letter
    return words.select("sheet", "line", "word_no", "text", x.alias("x"), (F.col("line") * line_height).alias("y"), (F.length("text") * letter).alias("w"), F.lit(line_height * 0.7).alias("h")).filter("text <> ''")


def keyed(words: DataFrame, reach: int, parts_of: str | None = None) -> DataFrame:
    """The words that have letters or figures, with what follows them in their line up to `reach` characters on: `ahead`,
    from the word itself on, as (word_no, right, key). Words of marks only have no key and stand in no one's way.

    A run that begins at a word can't come to a key once the words before its last one are longer than the key, so the
    frame is bounded by the key and not by a number of words. With `parts_of`, only words that stand in that key are kept;
    what was left out between them shows in `at`, the characters that stand before a word.
    """
    rows = words.select("sheet", "line", "word_no", "x", "y", "w", squash(F.col("text")).alias("key")).filter("key <> ''")
    line = Window.partitionBy("sheet", "line").orderBy("word_no")
    rows = rows.withColumn("at", F.sum(F.length("key")).over(line) - F.length("key"))
    rows = rows if parts_of is None else rows.filter(F.contains(F.lit(parts_of), F.col("key")))
    frame = Window.partitionBy("sheet", "line").orderBy("at").rangeBetween(0, reach)
    return rows.withColumn("ahead", F.collect_list(F.struct("word_no", (F.col("x") + F.col("w")).alias("right"), "key", "at")).over(frame))


def joined_keys(ahead: Column, k: Column) -> Column:
    return F.array_join(F.transform(F.slice(ahead, 1, k), lambda s: s["key"]), "")


def phrase_hits(words: DataFrame, phrase: str, errors: int) -> DataFrame:
    """(sheet, line, first, last, x, right, y): runs of words of a line that come to the phrase within `errors` edits, the
    shortest for each start, however many words that is. Keys are letters and figures only, so runs grow over
    punctuation, and a phrase is found that is spelled out letter by letter."""
    key = "".join(c for c in phrase if c.isalnum()).lower()
    numbers = F.sequence(F.lit(1), F.size("ahead"))
    if errors:
        rows = keyed(words, len(key) + errors)
        good = lambda k: F.length(joined_keys(F.col("ahead"), k)).between(len(key) - errors, len(key) + errors) & F.coalesce(within(joined_keys(F.col("ahead"), k), F.lit(key), errors), F.lit(False))
    else:
        # Every word of such a run stands in the phrase, the first at its beginning, and none is left out between.
        rows = keyed(words, len(key), key).filter(F.startswith(F.lit(key), F.col("key")))
        end = lambda k: F.element_at("ahead", k)
        good = lambda k: (end(k)["at"] + F.length(end(k)["key"]) - F.col("at") == len(key)) & (joined_keys(F.col("ahead"), k) == key)
    rows = rows.withColumn("k", F.array_min(F.filter(numbers, good))).filter("k IS NOT NULL").withColumn("end", F.element_at("ahead", F.col("k")))
    return rows.select("sheet", "line", F.col("word_no").alias("first"), F.col("end.word_no").alias("last"), "x", F.col("end.right").alias("right"), "y")


def label_hits(words: DataFrame, labels: list[str]) -> DataFrame:
    """As `phrase_hits` without errors, for several phrases in one pass over the words; `field_no` is a phrase's number.

    Every run of words that is no longer than the longest phrase is made once and looked up in the list of phrases;
    lines stay where they are.
    """
    keys: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        keys.setdefault("".join(c for c in label if c.isalnum()).lower(), []).append(i)
    rows = keyed(words, max(map(len, keys)))
    run = lambda k: F.struct(joined_keys(F.col("ahead"), k).alias("key"), k.alias("k"), F.element_at("ahead", k)["word_no"].alias("last"), F.element_at("ahead", k)["right"].alias("right"))
    runs = rows.select("sheet", "line", "word_no", "x", "y", F.explode(F.transform(F.sequence(F.lit(1), F.size("ahead")), run)).alias("r")).filter(F.col("r.key").isin(*keys))
    found = runs.groupBy("sheet", "line", "word_no", F.col("r.key").alias("key")).agg(F.min(F.struct("r.k", "r.last", "r.right", "x", "y")).alias("h"))
    numbers = F.create_map(*[v for k, ns in keys.items() for v in (F.lit(k), F.array(*[F.lit(n) for n in ns]))])
    return found.select("sheet", "line", F.col("word_no").alias("first"), F.col("h.last").alias("last"), F.col("h.x").alias("x"), F.col("h.right").alias("right"), F.col("h.y").alias("y"), F.explode(F.element_at(numbers, F.col("key"))).alias("field_no"))


def resolve_anchor(words: DataFrame, phrase: str) -> DataFrame:
    """(sheet, status, n, x, y): where a phrase stands on each sheet. An exact reading on any line goes before near ones;
    each line counts once; none is NotFound, more than one Ambiguous."""
    key = "".join(c for c in phrase if c.isalnum())
    errors = 0 if len(key) < 5 else len(key) // 4
    sheets = words.select("sheet").distinct()

    def per_line(hits: DataFrame) -> DataFrame:
        lines = hits.groupBy("sheet", "line").agg(F.min(F.struct("first", "x", "right", "y")).alias("h"))
        return lines.groupBy("sheet").agg(F.count("*").alias("n"), F.min(F.struct("line", "h.x", "h.right", "h.y")).alias("at"))

    exact = per_line(phrase_hits(words, phrase, 0)).select("sheet", F.col("n").alias("n0"), F.col("at").alias("a0"))
    near = per_line(phrase_hits(words, phrase, errors)).select("sheet", F.col("n").alias("n1"), F.col("at").alias("a1"))
    both = sheets.join(exact, "sheet", "left").join(near, "sheet", "left")
    n, at = F.coalesce("n0", "n1", F.lit(0)), F.coalesce("a0", "a1")
    status = F.when(n == 0, "NotFound").when(n == 1, "Found").otherwise("Ambiguous")
    one = lambda c: F.when(n == 1, at[c])
    return both.select("sheet", status.alias("status"), n.alias("n"), one("right").alias("x"), one("y").alias("y"))


#: Millimetres that a cover reaches beyond what it covers; height of the tallest letter to the size; mean letter width to the size.
PAD, TALLEST, LETTER = 0.6, 0.7, 0.5


def corrections(words: DataFrame, was: str, now: str) -> DataFrame:
    """(sheet, status, n, cover_x, cover_y, cover_w, cover_h, x, baseline, size_pt, over) to put `now` in the place of `was`.

    The phrase must stand on a sheet once (an exact reading goes before near ones): else the status is NotFound or
    FoundTwice and nothing is planned. The size comes from the tallest word of the line; `over` is by how much the new
    words are wider than the old, null where they aren't.
    """
    if not now.strip():
        raise ValueError(f"{was!r} does not say what to put there instead")
    key = "".join(c for c in was if c.isalnum())
    hits = [phrase_hits(words, was, e).withColumn("errors", F.lit(e)) for e in sorted({0, 0 if len(key) < 5 else len(key) // 4})]
    found = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
    found = found.withColumn("least", F.min("errors").over(Window.partitionBy("sheet"))).filter("errors = least")
    one = found.groupBy("sheet").agg(F.count("*").alias("n"), F.min(F.struct("line", "x", "right", "y")).alias("at"))
    heights = words.groupBy("sheet", "line").agg(F.max("h").alias("tallest"))
    out = words.select("sheet").distinct().join(one, "sheet", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("at", F.when(F.col("n") == 1, F.col("at"))).withColumn("line", F.col("at.line")).join(heights, ["sheet", "line"], "left")
    size, width = F.col("tallest") / TALLEST, F.col("at.right") - F.col("at.x")
    over = len(now) * size * LETTER - width
    status = F.when(F.col("n") == 0, "NotFound").when(F.col("n") == 1, "Planned").otherwise("FoundTwice")
    return out.select(
        "sheet", status.alias("status"), "n", (F.col("at.x") - PAD).alias("cover_x"), (F.col("at.y") - PAD).alias("cover_y"), (width + 2 * PAD).alias("cover_w"), (F.col("tallest") + 2 * PAD).alias("cover_h"),
        F.col("at.x").alias("x"), (F.col("at.y") + F.col("tallest")).alias("baseline"), (size * 72 / 25.4).alias("size_pt"), F.when(over > 0, over).alias("over"),
    )


def pick_fields(words: DataFrame, fields: list[dict]) -> DataFrame:
    """(sheet, field, status, text, n) in long form: what stands behind, or below, each label.

    No label is NoLabel, several are Twice with how many, one with nothing behind it is Blank. A value behind a label
    ends before another label or a word with a colon at its end; one below is made of the words of the next line within
    2.6 label heights, from 10 left of the label to 10 right of it.
    """
    sheets = words.select("sheet").distinct()
    labels = label_hits(words, [f["label"] for f in fields])
    part_of = labels.select("sheet", "line", F.explode(F.sequence("first", "last")).alias("word_no")).distinct().withColumn("is_label", F.lit(True))
    rows = words.join(part_of, ["sheet", "line", "word_no"], "left").withColumn("stop", F.coalesce("is_label", F.lit(False)) | F.col("text").rlike("[:：]$"))
    counts = labels.groupBy("sheet", "field_no").agg(F.count("*").alias("n"))
    single = labels.join(counts.filter("n = 1"), ["sheet", "field_no"])
    below = F.array(*[F.lit(f["place"] == "below") for f in fields])
    single = single.withColumn("below", F.element_at(below, F.col("field_no") + 1))

    word = rows.select(F.col("sheet").alias("ws"), F.col("line").alias("wl"), F.col("word_no").alias("wn"), "text", F.col("x").alias("wx"), F.col("w").alias("ww"), F.col("y").alias("wy"), "h", "stop")
    same = single.filter("NOT below").join(word, (F.col("sheet") == F.col("ws")) & (F.col("line") == F.col("wl")) & (F.col("wx") >= F.col("right") - 0.5))
    w = Window.partitionBy("sheet", "field_no").orderBy("wn").rowsBetween(Window.unboundedPreceding, 0)
    same = same.withColumn("stopped", F.max("stop").over(w)).filter("NOT stopped")
    # Below: lines within reach, of these the nearest.
    under = single.filter("below").join(word, (F.col("sheet") == F.col("ws")) & (F.col("wy") > F.col("y")) & (F.col("wy") - F.col("y") <= 2.6 * F.col("h")) & (F.col("wx") < F.col("right") + 10) & (F.col("wx") + F.col("ww") > F.col("x") - 10))
    under = under.withColumn("nearest", F.min("wl").over(Window.partitionBy("sheet", "field_no"))).filter("wl = nearest AND NOT stop")
    cols = ["sheet", "field_no", "wn", "text"]
    values = same.select(*cols).unionAll(under.select(*cols)).groupBy("sheet", "field_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("wn", "text"))), lambda s: s["text"]), " ").alias("value"))
    names = F.array(*[F.lit(f["name"]) for f in fields])
    spine = sheets.select("sheet", F.explode(F.sequence(F.lit(0), F.lit(len(fields) - 1))).alias("field_no"))
    out = spine.join(counts, ["sheet", "field_no"], "left").join(values, ["sheet", "field_no"], "left")
    status = F.when(F.col("n").isNull(), "NoLabel").when(F.col("n") > 1, "Twice").when(F.coalesce("value", F.lit("")) == "", "Blank").otherwise("Read")
    return out.select("sheet", F.element_at(names, F.col("field_no") + 1).alias("field"), status.alias("status"), F.when(status == "Read", F.col("value")).alias("text"), F.when(F.col("n") > 1, F.col("n")).alias("n"))


def suggestions(words: DataFrame, phrase: str, keep: int = 3, least: int = 3) -> DataFrame:
    """(sheet, line, said, run): of sheets, the lines that share the longest run of letters with a phrase, `least` or
    more; the first lines where none does."""
    from tallyframe.functions.text import common_run

    key = "".join(c for c in phrase if c.isalnum()).lower()
    lines = words.groupBy("sheet", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda s: s["text"]), " ").alias("said"))
    scored = lines.withColumn("run", common_run(squash(F.col("said")), F.lit(key))).withColumn("some", F.max("run").over(Window.partitionBy("sheet")) >= least)
    asked = scored.filter(~F.col("some") | (F.col("run") >= least))
    order = Window.partitionBy("sheet").orderBy(F.when(F.col("some"), -F.col("run")).otherwise(0), "line")
    return asked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).select("sheet", "line", "said", "run")
