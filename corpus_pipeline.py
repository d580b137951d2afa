"""The corpus pipeline: quality filter, exact dedup, near dedup, mixing, packing. Each stage takes the documents its predecessor kept; null or empty columns stop no stage, but documents without words are copies of each other to both dedup stages, and mixing drops them where their source has no words or a target below its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact, minhash, mixing, packing, quality, queries, simhash
from tessella.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id stays."""
    return exact.drop_copies(docs).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash fingerprints within four bits the document with the smallest doc_id stays; then, for copies that differ in more bits, of each component of those left whose five-word shingles are alike by 0.8 or more."""
    left = cut(simhash.keep_one(docs).select(*COLUMNS), "simhash")
    return simhash.keep_one(left, minhash.near_dedup).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document is there as many times as the mix takes it."""
    return mixing.take(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, digested, with their places in sequences."""
    parts = queries.tokenized(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(cut(parts, "pieces"))


STAGES = [("quality", good), ("exact_dedup", unique), ("near_dedup", distinct), ("mixing", mixed), ("packing", packed)]

#: Not expressible: the classifier's tables, XXH64 and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
