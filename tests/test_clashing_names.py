"""Inputs may have columns with the names that the operators use on the way."""

import pytest
from pyspark.sql import functions as F

from rooftop.operators.addresses import first_per_key, top_n
from rooftop.operators.numbering import global_row_number
from rooftop.operators.roofs import assign_roof_area
from rooftop.operators.yields import match_catalogue
from rooftop.plans.joins import join_dimension

NAMES = ("_rn", "_pos", "_part", "_place", "_n", "_offset", "_salt", "_salts", "_prefix", "_m", "dotted.name")


@pytest.fixture()
def wide(spark):
    return spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 4).alias("g"), *[F.lit(n).alias(n) for n in NAMES])


def kept(df):
    return all(r[n] == n for r in df.collect() for n in NAMES)


def test_numbering_and_roofs(wide):
    out = global_row_number(wide, "k", out="rn")
    assert kept(out) and sorted(r.rn for r in out.collect()) == list(range(1, 61))
    roofs = assign_roof_area(wide, key="k")
    assert kept(roofs) and roofs.count() == 60


def test_first_rows_and_cuts(wide):
    first = first_per_key(wide, ["g"], [F.col("k").desc()])
    assert kept(first) and sorted(r.k for r in first.collect()) == [56, 57, 58, 59]
    cut = top_n(wide, [F.col("k")], 7, strategy="tree", hash_cols=["k"])
    assert kept(cut) and sorted(r.k for r in cut.collect()) == list(range(7))


@pytest.mark.parametrize("strategy", ["auto", "salted", "uniform"])
def test_joins(spark, wide, strategy):
    dim = spark.createDataFrame([(i, f"d{i}") for i in range(4)], "g long, d string")
    out = join_dimension(wide, dim, "g", strategy=strategy, rows_per_task=5)
    assert kept(out) and out.count() == 60 and all(r.d == f"d{r.g}" for r in out.collect())


def test_catalogue_match(spark):
    requests = spark.createDataFrame([("A", 1, 2)], "request_name string, _prefix int, _m int")
    catalogue = spark.createDataFrame([("AB", 300.0, "CdTe")], "panel_name string, STC double, Technology string")
    assert match_catalogue(requests, catalogue).first().asDict() == {
        "request_name": "A", "_prefix": 1, "_m": 2, "panel_name": "AB", "kwp": 0.3, "pv_tech": "CdTe"}
