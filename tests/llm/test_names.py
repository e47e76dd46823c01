"""Columns that are called like anything of ours, groups named in capitals, and independent draws."""

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import mixing, quality, simhash, toxicity
from tallyframe.llm import textfeatures as tf

NAMES = ["__copy", "__row", "__fp", "__toxicity", "__q_kept", "copy", "row", "fp", "c0", "toxicity", "quality_kept", "Quality_N_words", "component_id", "size", "k0"]


def documents(spark):
    rows = [(i, f"word{i} " * 60 if i % 5 else "the same words here " * 15, "ab"[i % 2], "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return docs.withColumns({n: F.col("doc_id") * 100 + i for i, n in enumerate(NAMES)})


def own(rows):
    return all(r[n] == r["doc_id"] * 100 + i for r in rows for i, n in enumerate(NAMES))


def test_columns_called_like_ours_pass(spark):
    docs = documents(spark)
    mixed = mixing.emit(docs)
    assert mixed.columns == docs.columns and own(mixed.collect())
    kept = simhash.keep_one(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and own(rows) and len({r["doc_id"] for r in rows}) == len(rows) == 49
    none = tf.Linear(quality.SPEC, np.zeros(0, np.int64), np.zeros(0), 40.0)
    good = quality.keep_good(docs, none)
    assert good.columns == docs.columns and own(good.collect())
    clean = toxicity.keep_clean(docs, tf.Linear(toxicity.SPEC, none.buckets, none.weights, -40.0))
    assert clean.columns == docs.columns and clean.count() == 60 and own(clean.collect())


def test_groups_in_capitals():
    make = toxicity.wordings(most=1)
    for said, next_ in (("Étrangers ici", "citoyens ici"), ("die MÄNNER da", "die mädchen da"), ("un MUSULMÁN", "un cristiano"), ("Menschen mit\nBEHINDERUNG!", "menschen ohne behinderung!"), ("Weiße MENSCHEN", "schwarze menschen")):
        assert [t.decode() for t in make(said.encode())] == [next_]
    assert make("Männerchor, XÉtrangers, étrangersé".encode()) == [] and make(b"\xff\xfe") == []
    assert make("ſtraight İ".encode())  # a long s is an s


def test_independent_draws(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(3_000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, independent=True).collect()
    for s in "abc":
        mine = [r for r in got if r["source"] == s]
        whole, fraction = divmod(mine[0]["target"] / mine[0]["source_size"], 1)
        assert {r["copies"] for r in mine} <= {int(whole), int(whole) + 1}
        assert abs(sum(r["copies"] - whole for r in mine) - len(mine) * fraction) < 4 * (len(mine) * fraction * (1 - fraction)) ** 0.5 + 1e-9
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), independent=True).collect()))
