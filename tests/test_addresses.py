import datetime as dt

from rooftop.operators.addresses import OUTPUT_COLUMNS, latest_addresses

T = dt.datetime

ENTRANCES = [
    # objectId, postalCode, axisB, axisL, prn_id
    (1, "81101", "48.1", "17.1", 100),
    (2, "81101", "48.2", "17.2", 100),   # same building + postal: tie on changedAt -> smaller id (1)
    (3, "81102", "None", "17.3", 100),   # sentinel coordinate -> dropped
    (4, "81102", "48.4", "17.4", 100),
    (5, "82101", "48.5", "17.5", 200),   # building of another type
    (6, "83101", "48.6", "17.6", 300),   # building versions (changedAt differs)
    (7, "83101", "48.7", None, 300),     # NULL coordinate -> dropped
    (8, "84101", "48.8", "17.8", 999),   # entrance without building
    (9, "85101", "48.9", "17.9", 400),   # building without municipality
    (10, "86101", "48.10", "17.10", 500),  # other city
    (11, "87101", "48.11", "17.11", 600),  # NULL changedAt
    (12, "87101", "48.12", "17.12", 600),
]
BUILDINGS = [
    # objectId, type, changedAt, prn, municipality
    (100, "Rodinný dom", T(2021, 1, 1), 11, 1),
    (200, "Garáž", T(2021, 1, 1), 22, 1),
    (300, "Iná budova", T(2020, 1, 1), 33, 2),
    (300, "Iná budova", T(2022, 1, 1), 33, 2),
    (400, "Rodinný dom", T(2021, 1, 1), 44, 77),
    (500, "Rodinný dom", T(2021, 1, 1), 55, 3),
    (600, "Rodinný dom", None, 66, 1),
]
MUNICIPALITIES = [(1, "Bratislava - Ružinov"), (2, "BRATISLAVA - Petržalka"), (3, "Košice")]


def frames(spark):
    e = spark.createDataFrame(ENTRANCES, "objectId bigint, postalCode string, axisB string, axisL string, "
                                         "propertyRegistrationNumberIdentifier bigint")
    b = spark.createDataFrame(BUILDINGS, "objectId bigint, buildingTypeName string, changedAt timestamp_ntz, "
                                         "propertyRegistrationNumber bigint, municipalityIdentifier bigint")
    m = spark.createDataFrame(MUNICIPALITIES, "objectId bigint, municipalityName string")
    return e, b, m


def brute_force(spark, e, b, m, limit=25_000):
    for name, df in (("e", e), ("b", b), ("m", m)):
        df.createOrReplaceTempView(name)
    return spark.sql(f"""
      WITH j AS (
        SELECT e.objectId AS entranceObjectId, e.postalCode, nullif(e.axisB, 'None') AS axisB,
               nullif(e.axisL, 'None') AS axisL, b.objectId AS houseObjectId, b.buildingTypeName, b.changedAt,
               b.propertyRegistrationNumber, m.objectId AS addressObjectId, m.municipalityName
        FROM e JOIN b ON e.propertyRegistrationNumberIdentifier = b.objectId
               JOIN m ON b.municipalityIdentifier = m.objectId
        WHERE nullif(e.axisB, 'None') IS NOT NULL AND nullif(e.axisL, 'None') IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY postalCode, propertyRegistrationNumber, municipalityName,
                 buildingTypeName, houseObjectId, addressObjectId ORDER BY changedAt DESC NULLS LAST,
                 entranceObjectId) AS rn FROM j)
      SELECT entranceObjectId, postalCode, axisB, axisL, houseObjectId, buildingTypeName, changedAt,
             propertyRegistrationNumber, addressObjectId, municipalityName, 140 AS area FROM r
      WHERE rn = 1 AND buildingTypeName IN ('Rodinný dom', 'Iná budova')
        AND lower(municipalityName) LIKE '%bratislava%'
      ORDER BY changedAt DESC NULLS LAST, entranceObjectId LIMIT {limit}""")


def rows(df):
    return sorted(tuple(r) for r in df.select(*OUTPUT_COLUMNS).collect())


def test_latest_addresses_fixture(spark):
    e, b, m = frames(spark)
    got = latest_addresses(e, b, m)
    assert tuple(got.columns) == OUTPUT_COLUMNS
    ids = sorted(r.entranceObjectId for r in got.collect())
    assert ids == [1, 4, 6, 11]
    by_id = {r.entranceObjectId: r for r in got.collect()}
    assert by_id[6].changedAt == T(2022, 1, 1)  # latest building version
    assert by_id[11].changedAt is None
    assert rows(got) == rows(brute_force(spark, e, b, m))


def test_latest_addresses_independent_of_partitioning(spark):
    e, b, m = frames(spark)
    base = rows(latest_addresses(e, b, m))
    for n in (1, 3, 7):
        assert rows(latest_addresses(e.repartition(n), b.repartition(n), m.repartition(n))) == base


def test_limit_is_deterministic_top(spark):
    e, b, m = frames(spark)
    got = latest_addresses(e, b, m, limit=2)
    assert rows(got) == rows(brute_force(spark, e, b, m, limit=2))


def test_hot_building_key(spark):
    # one building holds most entrances: reduced before the join, same answer as brute force
    hot = [(i, f"8{i % 3}", f"48.{i}", f"17.{i}", 100) for i in range(20, 2000)]
    e = spark.createDataFrame(ENTRANCES + hot, "objectId bigint, postalCode string, axisB string, axisL string, "
                                               "propertyRegistrationNumberIdentifier bigint")
    _, b, m = frames(spark)
    assert rows(latest_addresses(e, b, m)) == rows(brute_force(spark, e, b, m))


def test_entrance_side_changed_at(spark):
    # stand-in form: only the entrances carry changedAt
    e = spark.createDataFrame(
        [(1, "A", "1", "1", 10, T(2020, 1, 1)), (2, "A", "1", "1", 10, T(2021, 1, 1)), (3, "A", "1", "1", 10, None)],
        "objectId bigint, postalCode string, axisB string, axisL string, "
        "propertyRegistrationNumberIdentifier bigint, changedAt timestamp_ntz")
    b = spark.createDataFrame([(10, "X", 1, 1)], "objectId bigint, buildingTypeName string, "
                                                "propertyRegistrationNumber bigint, municipalityIdentifier bigint")
    m = spark.createDataFrame([(1, "Town")], "objectId bigint, municipalityName string")
    got = latest_addresses(e, b, m, building_types=None, city=None).collect()
    assert [(r.entranceObjectId, r.changedAt) for r in got] == [(2, T(2021, 1, 1))]


def test_top_n_tree_equals_merge(spark):
    from pyspark.sql import functions as F

    from rooftop.operators.addresses import top_n
    import random
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "c int, i int").repartition(13)
    order = [F.col("c").desc_nulls_last(), F.col("i").asc()]
    for n in (1, 7, 250, 5000):
        merged = [tuple(r) for r in top_n(df, order, n).collect()]
        tree = [tuple(r) for r in top_n(df, order, n, strategy="tree", fan_in=4).collect()]
        assert sorted(tree, key=repr) == sorted(merged, key=repr)


def test_latest_addresses_tree_strategy(spark):
    e, b, m = frames(spark)
    for lim in (1, 2, 100):
        assert rows(latest_addresses(e, b, m, limit=lim, top_n_strategy="tree")) == \
            rows(latest_addresses(e, b, m, limit=lim))
