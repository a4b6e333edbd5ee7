"""A training-data pipeline: five stages over ``documents``, each written and read again.

Every stage keeps all columns of the rows that it keeps. Rows with a null id, or with an id that
occurs again, are documents of their own; rows that repeat an id and a text are one from the exact
dedup on. Null, empty and blank texts are equal, so one of them stays; it is packed as one separator. Of ties
the smallest id stays. An empty table gives an empty table. Columns with the names that the
operators use inside pass through unharmed.

A stage begins when the one before has been written; it first deletes the tables that the one
before wrote for itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from corpusloom.llm.wordfeatures import fold
from corpusloom.storage import cut, drop_set, table_set


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below 0.5; it learns from the labels of the training folds."""
    with table_set(spark, "stage"):
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(F.col("doc_id"), 5) != 0)
        return toxicity.drop_toxic(docs, labels)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    with table_set(spark, "stage"):
        return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more connect."""
    with table_set(spark, "stage"):
        return jaccard_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice."""
    with table_set(spark, "stage"):
        return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a document that is taken twice is packed twice."""
    with table_set(spark, "stage"):
        return packing.pack(docs, 2048)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("n-gram Jaccard join", remove_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the network nor the rounding; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces, as a written table of this run: a later run leaves it alone."""
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), uuid.uuid4().hex
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        with table_set(spark, f"output-{k}-{own}"):
            docs = cut(out, name.replace(" ", "-"))
        drop_set(spark, f"output-{k - 1}-{own}")
    drop_set(spark, "stage")
    return docs
