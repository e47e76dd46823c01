"""Quality rules: plain counts and a calibrated logistic model of hashed word and character n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import common
from tallyframe.llm import textfeatures as tf

#: Labelled rows that a fit takes at most, features that it keeps at most, and the probability a kept text needs.
MOST_ROWS, MOST_FEATURES, THRESHOLD = 10_000, 2_048, 0.5

#: The least words, and the most percent of words in repeated three-word windows, of a text that can be kept.
LEAST_WORDS, MOST_REPEATED = 50, 50

SPEC = tf.Spec(words=True, runs=(2,), grams=(2, 3, 4), lowered=False, bits=18, shares=True)

SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The plain counts of whole texts. Windows are compared by a 64-bit hash of their three words."""
    n = len(texts)
    data, starts, ends = common.joined(texts)
    blank = tf.blanks(data, starts, ends)
    w = tf.words_of(data, starts, ends, blank)
    out = {"n_words": np.bincount(w.doc, minlength=n)}

    def total(mark: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return sums[ends] - sums[starts]

    out["word_chars"] = total(~blank & ((data & 0xC0) != 0x80))
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = total(symbol[data])
    repeated = np.zeros(n, dtype=np.int64)
    for i, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                repeated[i] += 1
            elif line.split(None, 1):
                seen.add(line)
    out["n_dup_lines"] = repeated
    h, covered = w.hashes(), np.zeros(len(w.doc), dtype=bool)
    if len(h) >= 3:
        window = tf.stir(tf.stir(tf.stir(h[:-2]) * tf.U(3) + h[1:-1]) * tf.U(5) + h[2:]) ^ tf.stir(w.doc[:-2].astype(tf.U))
        inside = np.flatnonzero(w.doc[:-2] == w.doc[2:])
        order = inside[np.argsort(window[inside], kind="stable")]
        same = window[order[1:]] == window[order[:-1]]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(order) else np.zeros(0, dtype=bool)
        at = order[twice]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n)
    return out


def fit(docs: DataFrame, labels: DataFrame, spec: tf.Spec = SPEC, most_rows: int = MOST_ROWS, least: float = 12.0, where: Column | None = None) -> tf.Linear:
    """Fit on labelled rows (doc_id, quality), `most_rows` at most; a fifth of them only calibrates the probability.

    Without labelled rows of both classes the model keeps every text (or none, if all rows are of class 0).
    """
    sample = common.written(tf.labelled(docs, labels, F.col("quality"), most_rows, where=where), "quality-sample")
    buckets = tf.choose(sample, spec, 2, MOST_FEATURES, least)
    x = tf.gathered(sample, spec, buckets)
    yes, n = int(x.label.sum()), len(x.label)
    if yes in (0, n):
        return tf.Linear(spec, np.zeros(0, np.int64), np.zeros(0), -40.0 if n and not yes else 40.0)
    aside = np.arange(n) % 5 == 4
    w, constant = tf.fit_logistic(x, len(buckets), l2=1e-6, part=~aside)
    slope, shift = tf.fit_line((x.times(w) + constant)[aside], x.label[aside])
    return tf.Linear(spec, buckets, w, constant, slope, shift)


def judge(docs: DataFrame, model: tf.Linear, threshold: float = THRESHOLD, text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Add the plain counts, `base_failed`, `quality` (the calibrated probability) and `kept` to each row.

    base_failed: fewer than LEAST_WORDS words, or over MOST_REPEATED percent of the words in windows that occur twice.
    kept: not base_failed, and a probability of `threshold` or more. Null and empty texts have no words and fail;
    equal texts are judged alike; no rows give no rows. Columns called like a result are replaced, others pass (or
    only those in `keep`). The whole of a long text is read.
    """
    fields = [T.StructField(prefix + c, T.LongType()) for c in COUNTS] + [T.StructField(prefix + "base_failed", T.BooleanType()), T.StructField(prefix + "quality", T.DoubleType()), T.StructField(prefix + "kept", T.BooleanType())]

    def make():
        margins = model.scorer()

        def run(texts: list[bytes]) -> dict[str, np.ndarray]:
            got = counts(texts)
            failed = (got["n_words"] < LEAST_WORDS) | (100 * got["n_repeat_words"] > MOST_REPEATED * got["n_words"])
            good = tf.sigmoid(model.slope * margins(texts) + model.shift)
            return {prefix + k: v for k, v in (got | {"base_failed": failed, "quality": good, "kept": ~failed & (good >= threshold)}).items()}

        return run

    return common.map_texts(docs, text_col, make, fields, keep)


def keep_good(docs: DataFrame, model: tf.Linear, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with their own columns only."""
    prefix = common.unused(docs, "quality_")
    return judge(docs, model, threshold, prefix=prefix).filter(F.col(f"`{prefix}kept`")).select(*[F.col(f"`{c}`") for c in docs.columns])
