"""Quality grades by ordinal regression: one weight for each feature, ordered thresholds between the grades."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import common
from tallyframe.llm import textfeatures as tf

#: Labelled rows that a fit takes at most, and features that it keeps at most.
MOST_ROWS, MOST_FEATURES = 10_000, 2_048

SPEC = tf.Spec(words=True, grams=(2, 3, 4), again=3, lowered=False, bits=18, shares=True)


@dataclass
class Ordinal:
    """P(grade <= k) is the logistic function of threshold k minus the weighted features."""

    linear: tf.Linear
    thresholds: np.ndarray

    def tails(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and each threshold k."""
        return tf.sigmoid(margins[:, None] - self.thresholds[None, :])


def ordinal_gradient(x: tf.Sample, v: np.ndarray, width: int, l2: float) -> np.ndarray:
    """The gradient, in the weights and the thresholds, of minus the mean log likelihood and l2 * w^2."""
    n, y, grades = max(1, len(x.label)), x.label, len(v) - width + 1
    margin, cuts = x.times(v[:width]), np.concatenate([[-np.inf], v[width:], [np.inf]])
    with np.errstate(over="ignore"):
        high, low = 1 / (1 + np.exp(-np.clip(cuts[y + 1] - margin, -500, 500))), 1 / (1 + np.exp(-np.clip(cuts[y] - margin, -500, 500)))
    mass = np.maximum(high - low, 1e-12)
    dh, dl = high * (1 - high) / mass, low * (1 - low) / mass
    return np.concatenate([x.back((dh - dl) / n, width) + 2 * l2 * v[:width], [(np.where(y == k + 1, dl, 0) - np.where(y == k, dh, 0)).sum() / n for k in range(grades - 1)]])


def fit_ordinal(x: tf.Sample, width: int, grades: int, l2: float = 1e-6, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest likelihood (accelerated gradient; steps that disorder thresholds are mended)."""
    y = x.label
    share = np.clip([np.mean(y <= k) for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(grades - 1) * 1e-3)
    step = 1 / (0.5 * (x.curvature(width) + 1) + 2 * l2)
    z = np.concatenate([np.zeros(width), start])
    v, momentum = z.copy(), 1.0
    for _ in range(rounds):
        new = v - step * ordinal_gradient(x, v, width, l2)
        new[width:] = np.maximum.accumulate(new[width:] + np.arange(grades - 1) * 1e-9)
        faster = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v = new + (momentum - 1) / faster * (new - z)
        v[width:] = np.maximum.accumulate(v[width:] + np.arange(grades - 1) * 1e-9)
        z, momentum = new, faster
    return z[:width], z[width:]


def fit(docs: DataFrame, labels: DataFrame, grade: Column, grades: int, spec: tf.Spec = SPEC, most_rows: int = MOST_ROWS, least: float = 12.0, where: Column | None = None) -> Ordinal:
    """Fit on labelled rows, `most_rows` at most; `grade` is a whole number from 0 to grades - 1 made of label columns.

    Without labelled rows every grade is as likely as any other.
    """
    sample = common.written(tf.labelled(docs, labels, grade, most_rows, where=where), "grade-sample")
    buckets = tf.choose(sample, spec, grades, MOST_FEATURES, least)
    x = tf.gathered(sample, spec, buckets)
    if not len(x.label):
        share = np.arange(1, grades) / grades
        return Ordinal(tf.Linear(spec, np.zeros(0, np.int64), np.zeros(0)), np.log(share / (1 - share)))
    w, thresholds = fit_ordinal(x, len(buckets), grades)
    return Ordinal(tf.Linear(spec, buckets, w), thresholds)


def grade_texts(docs: DataFrame, model: Ordinal, least_grade: int = 1, sure: float = 0.5, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `expected_grade`, `tail_probability` (of `least_grade` or better) and `kept` (that is `sure` or more).

    Null and empty texts have no features and get the grades' plain shares; equal texts get equal grades; no rows
    give no rows. Columns called like a result are replaced, others pass (or only those in `keep`).
    """
    fields = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def make():
        margins = model.linear.scorer()

        def run(texts: list[bytes]) -> dict[str, np.ndarray]:
            tails = model.tails(margins(texts))
            tail = tails[:, least_grade - 1]
            return {"expected_grade": tails.sum(axis=1), "tail_probability": tail, "kept": tail >= sure}

        return run

    return common.map_texts(docs, text_col, make, fields, keep)
