"""The corpus pipeline: quality, toxicity, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillsight.llm import mixing, near_dedup, packing, quality, toxicity
from tillsight.llm.common import stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored as empty ones. Without labels the network is the one it
    starts from, which accepts or rejects alike for equal texts.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    Null and empty texts are scored as empty ones. Without labels nothing is rejected.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles.

    Null and empty texts and rows without an id are in no group and stay; of repeated rows with
    one id, the smallest text stays.
    """
    return near_dedup.keep_one(docs, words=5)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and empty texts stay once; a null source is a source of its own.
    """
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    Null and empty texts are one piece, the end id. Every row is packed, with or without an id.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("toxicity", civil_documents),
    ("near_dedup", one_of_each),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]

#: Learned models decide two of the stages; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
