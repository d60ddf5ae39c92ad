"""Documents to packed training sequences: classifier, rules, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import compression, dartminhash, line_dedup, packing, quality
from chartloom.llm.registered import tokenizer_file
from chartloom.llm.tables import read, ready, staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    ready(spark)
    return quality.kept_documents(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the compression bands."""
    ready(spark)
    return compression.kept_documents(docs, compression.fit(docs, read(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line equals or nearly equals; n_chars follows the text."""
    shorter = line_dedup.dedup_lines(docs).drop("n_lines", "n_dropped")
    return shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else shorter


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ready(spark)
    return dartminhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in the training sequences."""
    ready(spark)
    pieces = packing.pack(docs, tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("packing", pack_sequences),
]

#: A trained classifier and min-wise signatures have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what its predecessor kept; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
