import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rooftop.operators.intervals import time_weighted_hours, with_previous

T0 = datetime(2024, 3, 1, 9, 50)


@pytest.mark.parametrize("rows_per_range", [1_000_000, 7])
def test_previous_over_the_order_of_all_rows(spark, rows_per_range):
    rng = random.Random(2)
    data = [(rng.choice([None, *range(40)]), i, f"v{i}") for i in range(300)] + [(5, 1000 + i, "hot") for i in range(200)]
    df = spark.createDataFrame(data, "t int, id int, v string").repartition(9)
    out = with_previous(df.withColumn("_part", F.lit("own")).withColumn("_n", F.lit("n")), ["t", "id"], ["id", "v"],
                        rows_per_range=rows_per_range)
    assert out.columns == ["t", "id", "v", "_part", "_n", "previous"]
    want, last = {}, None
    for t, i, v in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[i], last = last, (i, v)
    assert {r.id: r.previous and tuple(r.previous) for r in out.collect()} == want


def test_wholly_tied_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a")] * 50, "t int, v string")
    out = with_previous(df, ["t"], ["v"], rows_per_range=5)
    assert sorted(str(r.previous and r.previous.v) for r in out.collect()) == ["None"] + ["a"] * 49 or \
        [r for r in out.collect() if r.previous is None].__len__() == 1
    assert with_previous(df.limit(0), ["t"], ["v"]).count() == 0


def hours(rows):
    """By hand: seconds and watt seconds for each hour, from (time, id, watts)."""
    out, last = {}, None
    for t, _, w in sorted(r for r in rows if r[0] is not None and r[2] is not None):
        if last is not None and timedelta(0) < t - last <= timedelta(hours=1):
            cut = max(last, t.replace(minute=0, second=0, microsecond=0))
            for start, end in ((last, cut), (cut, t)):
                if end > start:
                    h = out.setdefault(start.replace(minute=0, second=0, microsecond=0), [0.0, 0.0])
                    h[0] += (end - start).total_seconds()
                    h[1] += (end - start).total_seconds() * w
        last = t
    return sorted((h, round(s, 6), round(e / s, 6)) for h, (s, e) in out.items())


@pytest.mark.parametrize("rows_per_range", [1_000_000, 11])
def test_hours_against_a_walk(spark, rows_per_range):
    rng = random.Random(3)
    rows, t = [], T0
    for i in range(600):
        t += timedelta(seconds=rng.choice([0, 20, 20, 20, 21.5, 300, 1800, 3600, 3601, 9000]))
        rows.append((None if i % 50 == 7 else t, i, None if i % 60 == 9 else float(rng.randrange(900))))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id int, watts double").repartition(5)
    out = time_weighted_hours(df, tiebreak=["id"], rows_per_range=rows_per_range)
    assert sorted((r.hour, round(r.covered_s, 6), round(r.wats_per_meter, 6)) for r in out.collect()) == hours(rows)
    assert out.columns == ["hour", "timestamp", "label", "covered_s", "wats_per_meter"]


def test_even_readings_give_the_plain_mean_and_gaps_count_for_nothing(spark):
    rows = [(datetime(2024, 3, 1, 10) + timedelta(seconds=20 * i), float(i)) for i in range(181)]
    out = time_weighted_hours(spark.createDataFrame(rows, "ts timestamp_ntz, watts double")).collect()
    assert [(r.hour, r.covered_s, r.wats_per_meter) for r in out] == [(datetime(2024, 3, 1, 10), 3600.0, sum(range(1, 181)) / 180)]
    two = [(T0, 1.0), (T0 + timedelta(hours=2), 5.0)]
    assert time_weighted_hours(spark.createDataFrame(two, "ts timestamp_ntz, watts double")).count() == 0
    with pytest.raises(ValueError):
        time_weighted_hours(spark.createDataFrame(two, "ts timestamp_ntz, watts double"), max_gap_s=7200)
