import pytest

SF = "/root/testdata/sf0.001"

# null, empty and blank texts, ties, repeated rows, null ids
ODD = [
    (1, "", "en", "a"), (2, None, "en", "a"), (3, " \t\n ", "de", None), (4, "one two", None, "b"),
    (5, "x " * 30_000, "en", "b"), (None, "a text without an id " * 20, "fr", "b"), (None, None, None, None),
    (7, "same row twice over " * 30, "en", "a"), (7, "same row twice over " * 30, "en", "a"),
    (8, "other text under a repeated id", "en", "a"), (8, "text under a repeated id, other", "en", "a"),
    (9, "ünïcødé 𝔘𝔫𝔦 😀 words \x1c\x85  and spaces " * 12, "en", "c"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ("shard", "slot", "fingerprint", "component_id", "kept", "ids", "start", "offset", "score", "spans", "_row",
            "id", "p", "k1_", "doc_", "weight", "budget", "tokens", "base_", "epochs")


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def with_clashes(df, but=()):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(c).alias(c) for c in CLASHING if c not in but), F.lit(1).alias("dotted.name"))
