"""Corpus pipeline: language ID, near-duplicate removal, mixing, packing.

Each stage reads what the one before it wrote, works on all of it, and returns the columns of its
input; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillguard.llm import langid, minhash, mixing, packing, store
from quillguard.llm.queries import table, tokenizer

PACKED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the identifier rejects: no letter, or like no learned language."""
    return langid.known(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five-word shingles, similarity of 0.8 or more."""
    return minhash.kept(docs, store.scratch(spark, "stage-minhash"), k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their targets."""
    return mixing.mixed(docs, store.scratch(spark, "stage-mix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer(), capacity=2048, end_id=0).select(*PACKED)


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicates), ("mixing", mix), ("best-fit packing", pack)]

#: Language models and token ids can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = store.scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.saved(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
