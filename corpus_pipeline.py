"""The corpus pipeline: toxic documents go, one of each group of near copies stays, documents
with benchmark passages go, personal data is masked, and the rest becomes token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchflow.llm import bpe, decontaminate, ngram_join, pii, toxicity
from matchflow.llm.common import ready, stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below a half, learned from the labels of those that are there."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link, that with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it masked in the text."""
    return pii.sanitised(docs)


def as_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the bytes that they decode to."""
    return bpe.encode(docs, digested=True)


#: Name and function (spark, docs, sf_dir) -> DataFrame of every stage, in order.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("byte_bpe", as_token_ids),
]

#: Learned weights, components and merges: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
