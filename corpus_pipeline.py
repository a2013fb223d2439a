"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing; each stage works on what the last one kept.

Edge cases: documents with a NULL or empty text, or under twenty words, are rejected by the rules. A NULL source is a source,
a NULL id stays a row of its own, and rows that share an id are one document to the near duplicates. Other columns, of any
name, come along as far as the packing; names that the mixture makes itself (``mixing.MADE``) give way there. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strayfield.llm import exact_dedup, minhash, mixing, packing, quality
from strayfield.llm.queries import vocabulary
from strayfield.session import configure, cut_lineage

ORACLE_SQL = None  # near duplicates, the mixture's draw and the tokenizer have no SQL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failed lines."""
    return quality.clean(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and parts of documents that the mixture draws, repeats as rows of their own."""
    return mixing.documents(mixing.mixed(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece in a sequence."""
    return packing.packed(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
