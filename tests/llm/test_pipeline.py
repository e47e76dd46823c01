"""Each stage of the pipeline against what it must leave."""

from collections import Counter

import corpus_pipeline
import numpy as np
from test_operators import SCHEMA, brute_print, labelled_texts, shares

from tallyframe.llm import quality, queries, toxicity

CALLS = dict(corpus_pipeline.STAGES)


def folder(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, tmp_path):
    docs, labels = labelled_texts(spark, 500)
    again = docs.filter("doc_id < 40").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "'b' AS source", "n_chars")
    docs = docs.unionAll(again)
    sf = folder(spark, tmp_path, docs, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = CALLS["quality rules"](spark, docs, sf).cache()
    truth = {r["doc_id"]: r for r in labels.collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {i for i in [*range(500), *range(1000, 1040)] if truth[i % 1000]["quality"]}
    clean = CALLS["toxicity"](spark, good, sf).cache()
    assert {r["doc_id"] for r in clean.collect()} == {i for i in kept if not truth[i % 1000]["toxic"]}
    one = CALLS["near-duplicates"](spark, clean, sf).cache()
    prints: dict = {}
    for r in clean.collect():
        prints.setdefault(brute_print(r["text"]), []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(min(ids) for ids in prints.values())
    assert one.columns == docs.columns
    mixed = CALLS["mixing"](spark, clean, sf)
    sizes = Counter()
    for r in clean.collect():
        sizes[r["source"]] += len(r["text"].split())
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(r["text"].split())
    for s, want in shares(sizes).items():
        assert abs(taken[s] - want) < 0.02 * want + 150
    coded = CALLS["encoding"](spark, one, sf)
    assert coded.count() == one.count() and coded.filter("n_tokens = 0").count() == 0


def test_pipeline_runs_over_odd_rows(spark, tmp_path):
    docs, labels = labelled_texts(spark, 300)
    rng = np.random.default_rng(9)
    rows = [(None, None, None, None, None), (7_000, "", None, None, None), (7_001, "long " + " ".join(map(str, rng.integers(0, 1 << 40, 3000))), "en", "z", 1)]
    sf = folder(spark, tmp_path, docs.unionAll(spark.createDataFrame(rows, SCHEMA)).withColumn("n_tokens", docs["doc_id"]), labels)
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 50 and {"doc_id", "n_tokens", "ids"} <= set(out.columns)


def test_pipeline_runs_over_nothing(spark, tmp_path):
    docs, labels = labelled_texts(spark, 1)
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, docs.limit(0), labels.limit(0))).count() == 0


def test_registered():
    import __spark_entry__

    names = {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in __spark_entry__.queries()
    assert quality.THRESHOLD == 0.5 and toxicity.MOST_ROWS and queries.vocabulary()
