"""Corpus pipeline: quality classifier, n-gram Jaccard join, suffix-array dedup, packing.

Each stage is a function (spark, docs, sf_dir) over the rows its predecessor kept; all but the last return
the columns of documents. Nulls, empty and repeated rows are treated as the operators' docstrings say; rows
with null ids are kept as they are by the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import jaccard, packing, quality, suffix_dedup
from tessella.llm.common import Scratch
from tessella.llm.tokenizing import public_file


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts good."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id. Rows are told apart by id and text, so an id with
    several texts loses only those that are copies; rows of equal id and text are one document."""
    found = jaccard.near_duplicates(docs).where("doc_id is not null and component is not null").select("doc_id", "text_hash", "component").distinct()
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    gone = found.join(first, "component").where("struct(doc_id, text_hash) <> first").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text"))
    return docs.join(gone, (docs.doc_id == F.col("gone_id")) & (F.xxhash64(docs.text) == F.col("gone_text")), "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that stand elsewhere too."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    pieces = packing.pack_documents(docs, public_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Training a field, suffix order and tokenisers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
