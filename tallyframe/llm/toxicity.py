"""Toxicity: a logistic model over hashed words and word beginnings that must not care which group is named.

For each labelled text that names a group, wordings with another group of the same kind stand beside it, and the fit
penalises the square of the difference in margin. So a neutral mention can't carry a weight of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import common
from tallyframe.llm import textfeatures as tf

#: Words and phrases that name groups, by language and kind; any of a kind may stand for another. A list to begin with:
#: `fit` takes another as `groups`.
IDENTITY: dict[str, tuple[tuple[str, ...], ...]] = {
    "en": (
        ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("trans women", "trans men", "cis women", "cis men"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("gay", "lesbian", "bisexual", "transgender", "straight", "heterosexual"), ("gay people", "lesbian people", "straight people"),
        ("black", "white", "asian", "latino", "african", "european"), ("black people", "white people", "asian people", "people of color"),
        ("immigrants", "refugees", "foreigners", "natives", "citizens"), ("deaf", "blind", "disabled", "autistic"), ("people with disabilities", "people without disabilities"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
        ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"), ("schwul", "lesbisch", "bisexuell", "heterosexuell"), ("schwule", "lesben", "heterosexuelle"),
        ("ausländer", "flüchtlinge", "einwanderer", "einheimische"), ("schwarze menschen", "weiße menschen"), ("gehörlos", "blind", "behindert", "autistisch"), ("menschen mit behinderung", "menschen ohne behinderung"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons"), ("femme", "homme", "fille", "garçon"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
        ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"), ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
        ("immigrés", "réfugiés", "étrangers", "citoyens"), ("personnes noires", "personnes blanches", "personnes asiatiques"), ("sourd", "aveugle", "handicapé", "autiste"),
    ),
    "es": (
        ("mujeres", "hombres", "chicas", "chicos"), ("mujer", "hombre", "chica", "chico"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
        ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"), ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
        ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"), ("personas negras", "personas blancas", "personas asiáticas"), ("sordo", "ciego", "discapacitado", "autista"),
    ),
}

Groups = Mapping[str, Sequence[Sequence[str]]]

#: Labelled rows that a fit takes at most, features that it keeps at most, and wordings beside a text.
MOST_ROWS, MOST_FEATURES, WORDINGS = 24_000, 2_048, 2

#: How often a toxic row counts; they are few, and none should stay under the threshold for it.
YES = 8.0

SPEC = tf.Spec(words=True, prefixes=(4, 5, 6), bits=20)



@dataclass
class Model(tf.Linear):
    """The weights, the number of labelled texts that they were fitted on, and how many of those name a group: with
    none, the penalty had nothing to work on."""

    texts: int = 0
    swapped: int = 0


def naming(groups: Groups) -> tuple[re.Pattern[str], dict[str, str]]:
    """A pattern of the groups' names in any case of letters, longest first, with any white space between the words of a
    phrase and no letter beside it; and what comes next in the kind of each, that of the first language and kind that has it."""
    following: dict[str, str] = {}
    for kinds in groups.values():
        for kind in kinds:
            for i, name in enumerate(kind):
                following.setdefault(name.casefold(), kind[(i + 1) % len(kind)])
    names = {name.casefold(): name for kinds in groups.values() for kind in kinds for name in kind}
    each = [r"\s+".join(re.escape(w) for w in name.split()) for name in sorted(names.values(), key=len, reverse=True)]
    return re.compile(r"(?i)(?<![^\W\d_])(" + ("|".join(each) or "(?!)") + r")(?![^\W\d_])"), following


def wordings(groups: Groups = IDENTITY, most: int = WORDINGS) -> Callable[[bytes], list[bytes]]:
    """A function from a text to the text with each group named replaced by the next of its kind, by the one after, and so
    on; nothing for a text that names none."""

    held: list = []

    def named() -> tuple[re.Pattern[str], dict[str, str]]:
        if not held:  # once a task
            held.append(naming(groups))
        return held[0]

    def make(text: bytes) -> list[bytes]:
        pattern, following = named()
        said = text.decode("utf-8", "replace")
        if not pattern.search(said):
            return []
        out = []
        for _ in range(most):
            # Letters that only look alike without case, as a dotted capital I, leave a name as it is.
            said = pattern.sub(lambda m: following.get(" ".join(m[0].casefold().split()), m[0]), said)
            out.append(said.encode())
        return out

    return make


def fit(
    docs: DataFrame, labels: DataFrame, folds: int | None = 3, alike: float = 1.0, spec: tf.Spec = SPEC, most_rows: int = MOST_ROWS, least: float = 12.0, groups: Groups = IDENTITY
) -> Model:
    """Fit on the labelled rows of `docs`, `most_rows` at most (by hash of the id), of training folds where given.

    labels: (doc_id, toxic). Each text that names one of `groups` has wordings with others of the kind beside it, whose
    margins must be like its own (`alike` weighs the mean square of their differences); `swapped` tells how many do. A
    toxic row counts `YES` times, so probabilities lie higher than the share of toxic rows: the threshold of a verdict is to
    be chosen for that. Features are in units of their log odds between the classes, and those that speak against
    toxicity are left out, so that harmless words can't make up for an insult. Without labelled rows of both classes
    the model gives each text the share of toxic rows (0 if there are none).
    """
    where = common.training_row(F.col("doc_id"), folds) if folds else None
    sample = common.written(tf.labelled(docs, labels, F.col("toxic"), most_rows, where=where), "toxicity-sample")
    buckets = tf.choose(sample, spec, 2, MOST_FEATURES, least)
    x = tf.gathered(sample, spec, buckets, wordings(groups))
    yes, n, swapped = int(x.label[x.twin < 0].sum()), int((x.twin < 0).sum()), len(np.unique(x.twin[x.twin >= 0]))
    if yes in (0, n):
        return Model(spec, np.zeros(0, np.int64), np.zeros(0), 40.0 if n and yes else -40.0, texts=n, swapped=swapped)
    # In units of its log odds, a word that only toxic rows have moves far in each step, and one is enough for a verdict.
    real = (x.twin < 0)[x.doc]
    seen = [np.bincount(x.feature[real & (x.label[x.doc] == c)], minlength=len(buckets)) + 0.5 for c in (0, 1)]
    odds = np.maximum(0, np.log(seen[1] / (yes + 1)) - np.log(seen[0] / (n - yes + 1)))
    x.value *= odds[x.feature]
    w, constant = tf.fit_logistic(x, len(buckets), l1=3e-6, l2=1e-7, alike=alike, yes=YES, rounds=500)
    w = w * odds
    return Model(spec, buckets[w != 0], w[w != 0], constant, texts=n, swapped=swapped)


def score(docs: DataFrame, model: tf.Linear, text_col: str = "text", keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """Add the probability that the whole text is toxic.

    Null and empty texts get what the model says of no features; equal texts get equal scores; no rows give no rows.
    A column called like the result is replaced, others pass (or only those in `keep`).
    """

    def make():
        margins = model.scorer()
        return lambda texts: {name: tf.sigmoid(margins(texts))}

    return common.map_texts(docs, text_col, make, [T.StructField(name, T.DoubleType())], keep)


def keep_clean(docs: DataFrame, model: tf.Linear, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, with their own columns only."""
    name = common.unused(docs, "toxicity")
    return score(docs, model, name=name).filter(F.col(f"`{name}`") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
