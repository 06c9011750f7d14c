"""A corpus pipeline of five stages, each by one of the operators of ferrule.llm.

Documents in no recognised language go; of equal texts one stays; of near-duplicates (five-word shingles, similarity 0.8 or more) one
stays; sources are mixed to target weights in whole documents; and what is left is packed into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.exact_dedup import keep_first
from ferrule.llm.language_id import fit, held_out, keep_known
from ferrule.llm.mixing import mix
from ferrule.llm.near_dup import keep_one
from ferrule.llm.packing import pack
from ferrule.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language."""
    return keep_known(docs, fit(docs.where(~held_out(F.col("doc_id")))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts, A-Z lower-cased."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return keep_one(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to weights 1, 2, 3, repeating."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence; ids are little-endian unsigned 32-bit."""
    return pack(docs, tokenizer_file(), added=True)


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash", near), ("mixing", mixture), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    from ferrule.llm.staging import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
