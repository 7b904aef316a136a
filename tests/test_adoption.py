import hashlib

from pyspark.sql import functions as F

from rooftop.operators.adoption import (
    ADOPTION_LEVELS,
    adoption_totals,
    adoption_totals_bernoulli,
    keyed_draw,
    split_by_level,
    total_column,
)
from rooftop.operators.yields import YIELD_COLUMNS


def capacity(spark, n=3000):
    rows = [(i, f"M{i % 4}", *[float(i % 7) * k for k in (1, 4, 8, 10, 12)]) for i in range(n)]
    schema = "entranceObjectId bigint, municipalityName string, " + ", ".join(f"{c} double" for c in YIELD_COLUMNS)
    return spark.createDataFrame(rows, schema)


def test_total_column_names():
    assert [total_column(c) for c in YIELD_COLUMNS] == [
        "1_panel_total_mwh", "4_panel_total_mwh", "8_panel_total_mwh", "10_panel_total_mwh", "12_panel_total_mwh"]


def test_keyed_draw_matches_md5(spark):
    df = spark.createDataFrame([(k,) for k in (0, 1, 42, 10**12)], "k bigint")
    got = [r[0] for r in df.select(keyed_draw("k", seed=7)).collect()]
    want = [int(hashlib.md5(f"7:{k}".encode()).hexdigest()[:8], 16) % 10000 for k in (0, 1, 42, 10**12)]
    assert got == want


def test_levels_nest_and_full_level_is_everything(spark):
    cap = capacity(spark)
    draw = cap.select("entranceObjectId", keyed_draw("entranceObjectId").alias("u"))
    members = {p: {r[0] for r in draw.filter(F.col("u") < p * 100).collect()} for p in ADOPTION_LEVELS}
    assert members[15] <= members[30] <= members[50] <= members[100]
    assert len(members[100]) == 3000
    assert 0.10 < len(members[15]) / 3000 < 0.20

    tot = adoption_totals(cap)
    full = {r.municipalityName: r for r in tot.filter("adoption = 100").collect()}
    direct = {r.municipalityName: r for r in cap.groupBy("municipalityName")
              .agg(*[F.sum(c).alias(total_column(c)) for c in YIELD_COLUMNS]).collect()}
    assert {k: tuple(v)[2:] for k, v in full.items()} == {k: tuple(v)[1:] for k, v in direct.items()}


def test_totals_per_level_match_brute_force(spark):
    cap = capacity(spark, 500)
    rows = cap.select("*", keyed_draw("entranceObjectId").alias("u")).collect()
    tot = {(r.adoption, r.municipalityName): r["4_panel_total_mwh"] for r in adoption_totals(cap).collect()}
    for p in ADOPTION_LEVELS:
        for m in {r.municipalityName for r in rows}:
            want = sum(r.kwh_per_year_for_4_panel for r in rows if r.municipalityName == m and r.u < p * 100)
            assert abs(tot[(p, m)] - want) < 1e-9


def test_split_and_bernoulli(spark):
    cap = capacity(spark, 1000)
    parts = split_by_level(adoption_totals(cap))
    assert set(parts) == set(ADOPTION_LEVELS) and "adoption" not in parts[15].columns
    b = adoption_totals_bernoulli(cap, seed=3)
    assert sorted({r.adoption for r in b.collect()}) == list(ADOPTION_LEVELS)
    full = {r.municipalityName: r["1_panel_total_mwh"] for r in b.filter("adoption = 100").collect()}
    assert len(full) == 4


def test_bernoulli_full_level_and_rates(spark):
    cap = capacity(spark, 4000)
    b = {(r.adoption, r.municipalityName): r for r in adoption_totals_bernoulli(cap, seed=11).collect()}
    direct = {r.municipalityName: r[1] for r in cap.groupBy("municipalityName")
              .agg(F.sum("kwh_per_year_for_4_panel")).collect()}
    for m, v in direct.items():
        assert abs(b[(100, m)]["4_panel_total_mwh"] - v) < 1e-6
    n15 = adoption_totals_bernoulli(cap.withColumn("kwh_per_year_for_1_panel", F.lit(1.0)), seed=5) \
        .filter("adoption = 15").agg(F.sum("1_panel_total_mwh")).first()[0]
    assert 0.12 * 4000 < n15 < 0.18 * 4000


def test_bernoulli_levels_repeat_and_do_not_nest(spark):
    cap = capacity(spark, 3000)
    a = sorted(map(tuple, adoption_totals_bernoulli(cap, seed=9).collect()), key=repr)
    b = sorted(map(tuple, adoption_totals_bernoulli(cap.repartition(17), seed=9).collect()), key=repr)
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert all(abs(u - v) < 1e-6 for x, y in zip(a, b) for u, v in zip(x[2:], y[2:]))
    draws = [{r[0] for r in cap.filter(keyed_draw("entranceObjectId", 9 + i) < p * 100).select("entranceObjectId").collect()}
             for i, p in enumerate(ADOPTION_LEVELS)]
    assert not draws[0] <= draws[1] and not draws[1] <= draws[2]
