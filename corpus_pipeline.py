"""From documents to packed sequences: quality, line dedup, near-duplicate removal, secret redaction, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radonlake.llm import common, line_dedup, packing, quality, secrets, simhash


def sized(docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of these documents, doesn't reject. Null and empty texts are scored as texts without words;
    rows that repeat are scored each; labels of unknown or null ids don't count."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that many share. Every document stays, a null or emptied text as an empty one; columns named as the operator's counts are kept."""
    return sized(line_dedup.dedup_lines(docs, counts=False))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates; one without an id stays only where its group has none."""
    return simhash.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose secrets are replaced by a mark; a null text stays null."""
    return sized(secrets.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's ids goes; a null or empty text is the end id alone. A table without rows gives one without rows, here as in all stages."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_good), ("line dedup", drop_lines), ("near duplicates", drop_near_duplicates), ("secrets", redact), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is a Parquet table in the shared folder, which the next one reads."""
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
