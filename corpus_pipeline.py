"""Corpus pipeline: what five of the corpus operators decide takes effect one after another.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from denseblocks.llm import decontaminate, mixing, ngram_join, quality, queries, token_index
from denseblocks.llm.common import Stage, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts are scored
    as any; repeated rows go or stay together; without labels all stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document, as ``ngram_join.one_of_each_group`` says."""
    return ngram_join.one_of_each_group(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands. Null and empty texts, which have no
    window, stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, or up to three rows. Documents
    without words are taken as often as their source is taken whole."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids in indexed shards, read back from there. A null text is empty;
    an empty one is its end id alone; repeated rows are documents of their own."""
    path = Stage(spark, "pipeline").path("shards")
    token_index.write(docs, path, queries.vocabulary(), queries.END_ID, queries.VOCABULARY)
    return token_index.read_documents(spark, path)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_ids),
]

#: Learned scores and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on all rows and columns that the one before
    kept. Columns besides those of ``documents`` go along, whatever their names; an empty table
    gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    stage = Stage(spark, "corpus")
    for i, (_, step) in enumerate(STAGES[:-1]):
        docs = stage.put(step(spark, docs, sf_dir), f"{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
