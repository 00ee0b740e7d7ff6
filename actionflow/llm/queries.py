"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionflow.llm.scratch import bounded_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows; the nearest ten others of each."""
    from actionflow.llm.hamming_search import sign_code, top_k

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.where("id % 50 = 0"), k=10)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actionflow.llm.quality_classifier import report

    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text", "source AS host", "lang AS path")
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id AS id", "quality AS good")
    return report(docs, labels).withColumnRenamed("id", "doc_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actionflow.llm.license_scan import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"))


def op4_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actionflow.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actionflow.llm.sentencepiece_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actionflow.llm.html_extraction import extract

    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actionflow.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actionflow.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actionflow.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from actionflow.llm.quality_rules import report

    return report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [op1_hamming_top_k, op2_quality_classifier, op3_license_scan, op4_ring_sharding, op5_sentencepiece, op6_html_extraction, op7_warc_chunks, op8_minhash_near_duplicates, op9_best_fit_packing, op10_quality_rules]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from actionflow.llm import oracles

    return {k: v for k, v in oracles.ORACLES.items() if k in queries()}
