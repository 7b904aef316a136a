"""The corpus pipeline: quality rules, near duplicates, personal data, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to a table in the shared checkpoint folder and rereads it as the
next stage's documents.  All stages but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rooftop.llm import mixing, packing, pii, repetition, simhash
from rooftop.llm.common import stash, table
from rooftop.llm.queries import WEIGHTS, mixture_levels, word_count


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the repetition measures reject go."""
    return repetition.keep_unrepetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_one_per_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; ``n_chars`` follows the text."""
    redacted = pii.redact(docs)
    return with_length(redacted) if "n_chars" in docs.columns else redacted


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: not at all, once, in several epochs, or, at a cut, in part."""
    mixed = mixing.mix(docs, mixture_levels(), WEIGHTS, word_count(F.col("text")))
    copies = mixing.take_copies(mixed, "text")
    return with_length(copies) if "n_chars" in docs.columns else copies


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows."""
    return packing.piece_crc32(packing.pack_documents(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixture", source_mixture),
    ("packing", pack),
]

# Fingerprints need XXH64 and token ids a vocabulary: not expressible in SQL.
# The stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
