"""The registered queries of the operators, thin over their modules, and their SQL.

Every query reads its whole tables.  ``ORACLE_SQL`` has DuckDB queries for
those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import licenses, merkle, mixing, nearest, packing, pii, repair, repetition, separators, sharding, simhash, toxicity, url_reputation
from .common import table
from .oracles import license_sql, merkle_sql, mixture_sql, repair_sql, repetition_sql, url_reputation_sql
from .url_reputation import Rule

Builder = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host reputation of ``pages``; a page's outcome is the quality label of its id."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page"), (1 - F.col("quality")).alias("bad"))
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return judged.withColumn("bad_rate_low", F.round("bad_rate_low", 6))


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sharded = sharding.external_shuffle(docs, 40)
    return sharded.select(
        "doc_id", sharding.record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"))


# Target weights: languages among a domain's, domains among the corpus's.
DOMAINS = 4
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0},
           "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def mixture_levels() -> dict:
    """Domain, language, source: sources fall into domains by a hash of their names."""
    domain = F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(DOMAINS)).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def word_count(text):
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0))


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in a mixture of as many tokens (here: words) as there are."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixture_levels(), WEIGHTS, word_count(F.col("text")))
    return mixed.select("doc_id", "lang", "source", "epochs", "part_tokens")


def op7_pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_crc32(packing.pack_documents(table(spark, sf_dir, "documents")))


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge_repetition(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of ``documents``, found in flat token files written for the purpose."""
    return separators.token_counts(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Builder] = {f.__name__: f for f in (
    op1_url_reputation, op2_external_shuffle, op3_personal_data, op4_simhash_groups, op5_nearest_neighbours,
    op6_source_mixture, op7_pack_tiers, op8_repetition, op9_toxicity, op10_separator_scan, op11_merkle_manifest, op12_license_scan,
    op13_conversation_repair)}

ORACLE_SQL: dict[str, str] = {
    "op1_url_reputation": url_reputation_sql(URL_RULES),
    "op6_source_mixture": mixture_sql(WEIGHTS, DOMAINS),
    "op8_repetition": repetition_sql(),
    "op11_merkle_manifest": merkle_sql(),
    "op12_license_scan": license_sql(licenses.default_rules()),
    "op13_conversation_repair": repair_sql(),
}
