"""A training corpus from raw documents: drop bad ones, keep one of each near copy, pack.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept,
and returns a DataFrame; ``run`` applies them in order, each stage written as a
Parquet table in the folder that the cluster shares and read again. All but the
last return documents with their columns as they were. Every stage is judged on
its own input: sites, hosts and groups are those of the documents it gets.

Shingles have five words and documents are near at a similarity of 0.8, the operator's
defaults; the query of that operator alone asks for four words, as its contract does.

Defined results: documents with a null or empty text, or one of white space, are
rejected by the first stage; null sources and languages are sites of their own; rows
alike in everything are judged alike, and of those alike in id and text one goes on; a
null id stays null to the end; an empty table gives no rows; columns besides those of
``documents`` go through all stages but the last, whatever their names. A lost executor
costs the work since the last table of its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actionflow.llm import near_duplicates, packing, quality_classifier, quality_rules
from actionflow.llm.scratch import bounded_batches, clear, mark, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = bounded_batches(spark).read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id AS id", "quality AS good")
    return quality_classifier.keep_good(docs, labels)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle and a similarity of 0.8: the operator's defaults."""
    bounded_batches(spark)
    return near_duplicates.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("near-duplicates", deduplicate),
    ("packing", pack),
]

#: A trained classifier is no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once a stage's result is a table, all tables behind it are deleted: the folder holds what two stages need at most."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        clear(spark, start, keep=docs)
    return docs
