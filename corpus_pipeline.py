"""A pipeline over `documents`: language, near-duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillview.llm import decontaminate, language, simhash, suffixes, tokenize
from rillview.llm.common import discard, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which the classifier, fitted on these docs, finds a language; the others (no letter, no text) go."""
    model = language.fit(docs.filter(~language.held_out(docs["doc_id"])))
    return language.with_language(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are linked by a Jaccard similarity of 0.8 or more over 5-word shingles, the first."""
    return simhash.one_of_each(docs, 5, 0.8)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests and ids (array<int>)."""
    return tokenize.encode_documents(docs, full=True).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", without_repeated_passages),
    ("benchmark", without_benchmark),
    ("token_ids", token_ids),
]

#: The classifier, the components and the encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
            discard(last)
            last = docs
    return docs
