"""A training-data pipeline: toxicity, near duplicates, source mix, packed windows.

Each stage takes (spark, docs, folder) and returns a table that is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from noteframe.llm import mixing, queries, similar, toxicity
from noteframe.llm.common import read
from noteframe.sources.tables import work_dir


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; all others stay as they are."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class (SimHash of five words, similarity 0.8) the smallest doc_id stays."""
    return similar.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in the order, that the mix of sources takes them."""
    return mixing.training_order(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of tokens."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packed_windows),
]

#: Trained scores, links over several steps and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; results of stages go to the shared working folder."""
    top = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{top}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
