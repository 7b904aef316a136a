import re

import pytest
from pyspark.sql import functions as F

from rooftop.operators.addresses import latest_addresses
from rooftop.operators.upkeep import KeyedStore, affected_houses, refreshed_addresses

SCHEMA = "id long, a string, b double"


def kinds(changes):
    return sorted(((r.change, tuple(r.before) if r.before else None, tuple(r.after) if r.after else None)
                   for r in changes.collect()), key=str)


def test_classes_of_rows(spark, tmp_dir):
    old = [(1, "x", 1.0), (2, "y", None), (3, None, 2.0), (4, "z", 3.0), (None, "n", 0.0)]
    new = [(1, "x", 1.0), (2, None, None), (3, None, 2.0), (5, "w", 1.0), (None, "n", 0.0)]
    store = KeyedStore(tmp_dir + "/s", ["id"], 3)
    store.write(spark.createDataFrame(old, SCHEMA))
    changes = store.changes(spark.createDataFrame(new, SCHEMA))
    assert kinds(changes) == sorted([
        ("same", old[0], new[0]), ("changed", old[1], new[1]), ("same", old[2], new[2]), ("gone", old[3], None),
        ("new", None, new[3]), ("gone", old[4], None), ("new", None, new[4])], key=str)
    assert sorted(map(tuple, store.updated(changes).collect()), key=str) == sorted(new, key=str)


def test_values_moving_between_columns_are_a_change(spark, tmp_dir):
    store = KeyedStore(tmp_dir + "/s", ["id"])
    store.write(spark.createDataFrame([(1, "v", None)], "id long, a string, b string"))
    changes = store.changes(spark.createDataFrame([(1, None, "v")], "id long, a string, b string"))
    assert [r.change for r in changes.collect()] == ["changed"]


def test_repeated_keys_and_columns_in_another_order(spark, tmp_dir):
    store = KeyedStore(tmp_dir + "/s", ["id", "a"])
    store.write(spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (1, "x", 2.0)], SCHEMA))
    new = spark.createDataFrame([(1.0, 1, "x"), (2.0, 1, "x")], "b double, id long, a string").select("id", "a", "b")
    changes = store.changes(new)
    assert sorted(map(tuple, store.updated(changes).collect())) == [(1, "x", 1.0), (1, "x", 2.0)]
    with pytest.raises(ValueError):
        store.changes(new.drop("b"))


def test_the_stored_side_is_not_shuffled_or_sorted(spark, tmp_dir):
    store = KeyedStore(tmp_dir + "/s", ["id"], 8)
    store.write(spark.range(1000).selectExpr("id", "cast(id as string) a", "1d b"))
    changes = store.changes(spark.range(500, 1500).selectExpr("id", "cast(id as string) a", "1d b"))
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "FullOuter" in plan
    stored = plan[:plan.index("Window")] if "Window" in plan else plan
    # one exchange: that of the delivery; the bucketed scan feeds the join as it is
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "Bucketed: true" in plan and "Sort" not in stored.split("Bucketed: true")[0]
    assert changes.groupBy("change").count().collect().__len__() == 3


def _registers(spark, seed, rows=400):
    import random
    rng = random.Random(seed)
    base = random.Random(1)
    entrances = [(i, str(base.randrange(3)), base.choice(["48.1", "48.2", None, "None"]), "17.1", base.randrange(60))
                 for i in range(rows)]
    out = []
    for e in entrances:
        x = rng.random()
        if seed and x < .05:
            continue
        if seed and x < .15:
            e = (e[0], e[1], rng.choice(["48.3", "None"]), e[3], rng.randrange(60))
        out.append(e)
    if seed:
        out += [(10_000 + i, "1", "48.9", "17.9", rng.randrange(60)) for i in range(20)]
    return spark.createDataFrame(out, "objectId long, postalCode string, axisB string, axisL string, "
                                      "propertyRegistrationNumberIdentifier long")


@pytest.mark.parametrize("seed", [1, 2])
def test_base_and_delta_equal_a_rebuild(spark, tmp_dir, seed):
    buildings = spark.createDataFrame(
        [(i, "A" if i % 4 else "B", i, i % 5, f"2024-01-{1 + i % 28:02d}") for i in range(60)] +
        [(i, "A", i, i % 5, "2024-02-01") for i in range(0, 60, 7)],
        "objectId long, buildingTypeName string, propertyRegistrationNumber long, municipalityIdentifier int, changedAt string") \
        .withColumn("changedAt", F.col("changedAt").cast("timestamp_ntz"))
    changed = buildings.withColumn("buildingTypeName", F.when(F.col("objectId") % 11 == 0, "B").otherwise(F.col("buildingTypeName"))) \
        .filter(F.col("objectId") != 13)
    towns = spark.createDataFrame([(i, f"town {i}") for i in range(5)], "objectId int, municipalityName string")
    opts = {"building_types": ["A"], "city": None}
    old, new = _registers(spark, 0), _registers(spark, seed)
    store, houses = KeyedStore(tmp_dir + "/e", ["objectId"]), KeyedStore(tmp_dir + "/b", ["objectId", "changedAt"])
    store.write(old)
    houses.write(buildings)
    latest_addresses(old, buildings, towns, **opts).write.parquet(tmp_dir + "/a")
    e, b = store.changes(new), houses.changes(changed)
    affected = affected_houses(e, b)
    fresh = refreshed_addresses(spark.read.parquet(tmp_dir + "/a"), affected, store.updated(e), houses.updated(b), towns, **opts)
    want = latest_addresses(new, changed, towns, **opts)
    assert sorted(map(tuple, fresh.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert 0 < affected.count() < 60
    with pytest.raises(ValueError):
        refreshed_addresses(want, affected, new, changed, towns, limit=5)
