"""From raw documents to token ids: quality rules, toxicity, near-duplicates, mixing to target weights, encoding.

Each stage takes the documents that the one before left and returns documents of the same columns, the last one token
ids. Models are fitted on labelled rows among the documents that the stage gets, which has no bearing on how the rest
are judged. Rejected documents go; of each group of near-duplicates one stays; mixing repeats documents or leaves them
out, as their source's rate says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import bpe, common, mixing, quality, queries, simhash, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the plain rules and the calibrated model keep."""
    return quality.keep_good(docs, quality.fit(docs, queries.table(spark, sf_dir, "labels")))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.7; all labelled ones are there to learn from."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, queries.table(spark, sf_dir, "labels"), folds=None))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that with the smallest id.

    Three bits may differ, one more than in op5's contract: on the check tables that finds 44 % of the pairs of different
    texts that share 0.8 or more of their five-word shingles, instead of 24 %, and no pair below 0.55.
    """
    return simhash.keep_one(docs, bits=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their sources' rates say."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, with their digests and those of the texts decoded from them."""
    return bpe.encode_texts(docs, queries.vocabulary, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near-duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The models and the encoder are not expressible in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next. What a stage has written
    on its way, and what the stage before left, is removed; the last stage's table stays."""
    docs, left = queries.table(spark, sf_dir, "documents"), []
    for n, (_, stage) in enumerate(STAGES, 1):
        with common.Temporary(spark) as inner:
            docs = inner.keep(common.written(stage(spark, docs, sf_dir), f"stage{n}"))
        common.forget(*left)
        left = [docs]
    return docs
