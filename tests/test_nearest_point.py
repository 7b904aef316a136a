import random

import pytest
from pyspark.sql import functions as F

from rooftop.operators.nearest_point import attach_nearest_yield, nearest_points, scaled_longitude


def brute(addresses, points):
    out = {}
    for i, x, y in addresses:
        best = None
        if x is not None and y is not None and x == x and y == y:
            best = min((((x - px) * (x - px) + (y - py) * (y - py)), p) for p, px, py in points
                       if p is not None and px is not None and py is not None) if points else None
        out[i] = best and (best[1], best[0] ** .5)
    return out


def got(df):
    return {r.id: None if r.nearest is None else (r.nearest, r.nearest_distance) for r in df.collect()}


def frames(spark, addresses, points):
    return (spark.createDataFrame(addresses, "id int, x double, y double"),
            spark.createDataFrame(points, "p int, px double, py double"))


def search(spark, addresses, points, **kw):
    a, p = frames(spark, addresses, points)
    return nearest_points(a, p, x="x", y="y", point_x="px", point_y="py", point_id="p", **kw)


@pytest.mark.parametrize("width", [None, 0.01, 3.0, 500.0])
def test_against_all_pairs(spark, width):
    rng = random.Random(8)
    points = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(80)] + [(100 + i, 50.0 + i, -70.0) for i in range(3)] \
        + [(90, 0.5, 0.5), (91, 0.5, 0.5), (None, 0.0, 0.0), (95, None, 1.0)]
    addresses = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(150)] + [(1000, 300.0, 300.0), (1001, None, 1.0),
                 (1002, float("nan"), 0.0), (1003, 0.5, 0.5), (1004, 51.0, -70.0), (1005, -1e6, 1e6)]
    want = brute(addresses, points)
    out = got(search(spark, addresses, points, width=width))
    assert set(out) == set(want)
    for i in want:
        assert (out[i] is None) == (want[i] is None) and (want[i] is None or out[i] == pytest.approx(want[i])), i


def test_ties_go_to_the_smallest_id_and_points_on_a_line(spark):
    points = [(3, 0.0, 1.0), (2, 0.0, -1.0), (9, 1.0, 0.0), (5, -1.0, 0.0)]
    assert got(search(spark, [(1, 0.0, 0.0)], points))[1] == (2, 1.0)
    line = [(i, float(i), 0.0) for i in range(50)]
    assert got(search(spark, [(i, i + .2, 5.0) for i in range(50)], line)) == {
        i: (i, pytest.approx((.2 ** 2 + 25) ** .5)) for i in range(50)}
    assert got(search(spark, [(1, 2.0, 3.0)], [(7, 9.0, 9.0)]))[1][0] == 7


def test_repeated_addresses_extra_columns_and_no_points(spark):
    a, p = frames(spark, [(1, 0.0, 0.0)] * 3, [(4, 1.0, 1.0)])
    out = nearest_points(a.withColumn("_x", F.lit("own")), p, x="x", y="y", point_x="px", point_y="py", point_id="p")
    assert out.count() == 3 and out.columns == ["id", "x", "y", "_x", "nearest", "nearest_distance"]
    assert got(search(spark, [(1, 0.0, 0.0)], [])) == {1: None}
    assert search(spark, [], [(4, 1.0, 1.0)]).count() == 0


def test_yield_of_the_nearest_point_with_a_reply(spark):
    addresses = spark.createDataFrame([(1, "48.1", "17.1"), (2, "48.9", "17.9"), (3, "None", "17.0")],
                                      "id int, axisB string, axisL string")
    yields = spark.createDataFrame([(10, "48.1", "17.1", None), (11, "48.2", "17.2", 2.0), (12, "48.8", "17.8", 3.0)],
                                   "request_id int, lat string, lon string, kwh_per_year_for_1_panel double")
    rows = {r.id: r for r in attach_nearest_yield(addresses, yields).collect()}
    assert [(rows[i].request_id, rows[i].kwh_per_year_for_12_panel) for i in (1, 2, 3)] == [(11, 24.0), (12, 36.0), (None, None)]


def test_scaled_longitude(spark):
    r = spark.range(1).select(scaled_longitude(F.lit(10.0), 60.0).alias("x")).first()
    assert r.x == pytest.approx(5.0)
