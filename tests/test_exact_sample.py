import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rooftop.operators.exact_sample import adoption_totals_exact

LEVELS = (15, 30, 50, 100)


def brute(rows, levels, seed=0):
    groups = {}
    for key, group, v in rows:
        text = "NULL" if key is None else str(key)
        groups.setdefault(group, []).append((int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:15], 16), v))
    out = []
    for group, rows_ in groups.items():
        rows_.sort(key=lambda r: r[0])
        for p in levels:
            k = (2 * p * len(rows_) + 100) // 200
            if k:
                vs = [v for _, v in rows_[:k] if v is not None]
                out.append((p, group, k, round(sum(vs), 6) if vs else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r[1], r[2], None if r[3] is None else round(r[3], 6)) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "entranceObjectId long, municipalityName string, kwh_per_year_for_1_panel double")


@pytest.mark.parametrize("ranked_rows", [1_000_000, 3, 0])
def test_exact_counts_and_sums(spark, ranked_rows):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None, f"t{i % 40}"]), rng.choice([None, float(i % 13)])) for i in range(5000)]
    out = adoption_totals_exact(frame(spark, rows), columns=["kwh_per_year_for_1_panel"], ranked_rows=ranked_rows)
    assert out.columns == ["adoption", "municipalityName", "households", "1_panel_total_mwh"]
    assert got(out) == brute(rows, LEVELS)


@pytest.mark.parametrize("ranked_rows", [1_000_000, 1])
def test_one_key_in_most_rows(spark, ranked_rows):
    rows = [(7, "g", 1.0)] * 90 + [(None, "g", 1.0)] * 10 + [(7, None, 2.0)] * 7
    out = adoption_totals_exact(frame(spark, rows), columns=["kwh_per_year_for_1_panel"], ranked_rows=ranked_rows)
    assert sorted((r[0], r[1] or "", r[2]) for r in out.collect()) == sorted(
        [(p, "g", p) for p in LEVELS] + [(p, "", (2 * p * 7 + 100) // 200) for p in LEVELS])


def test_levels_nest_and_small_groups(spark):
    rows = [(i, f"g{i}", 1.0) for i in range(5)] + [(i, "two", 1.0) for i in (100, 101)]
    out = adoption_totals_exact(frame(spark, rows), levels=(10, 50, 100), columns=["kwh_per_year_for_1_panel"])
    assert got(out) == brute(rows, (10, 50, 100))
    assert all(r.households == 1 for r in out.filter(F.col("municipalityName") != "two").collect())


def test_empty_and_bad_levels(spark):
    assert adoption_totals_exact(frame(spark, []), columns=["kwh_per_year_for_1_panel"]).count() == 0
    with pytest.raises(ValueError):
        adoption_totals_exact(frame(spark, []), levels=(0,))
