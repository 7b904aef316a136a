"""Randomised properties: operators equal their brute-force definitions."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rooftop.operators.adoption import adoption_totals
from rooftop.operators.numbering import global_row_number
from rooftop.operators.yields import match_catalogue

SETTINGS = dict(max_examples=8, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))


@settings(**SETTINGS)
@given(keys=st.lists(st.integers(-10**12, 10**12), min_size=1, max_size=300, unique=True),
       per_bucket=st.integers(10, 50))
def test_row_number_property(spark, keys, per_bucket):
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: r.rn for r in global_row_number(df, "k", rows_per_range=per_bucket).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


names = st.text(alphabet="ab_.-", min_size=0, max_size=6)


@settings(**SETTINGS)
@given(catalogue=st.lists(names, min_size=1, max_size=30, unique=True),
       requests=st.lists(names, min_size=1, max_size=15))
def test_prefix_match_property(spark, catalogue, requests):
    cat = spark.createDataFrame([(c, float(i), "CdTe") for i, c in enumerate(catalogue)],
                                "panel_name string, STC double, Technology string")
    req = spark.createDataFrame([(r,) for r in requests], "request_name string")
    got = sorted((r.request_name, r.panel_name) for r in match_catalogue(req, cat).collect())
    want = sorted((r, min((c for c in catalogue if c.startswith(r)), default=None)) for r in requests)
    assert got == want


@settings(**SETTINGS)
@given(ids=st.lists(st.integers(0, 10**9), min_size=1, max_size=200, unique=True), seed=st.integers(0, 99))
def test_adoption_levels_property(spark, ids, seed):
    df = spark.createDataFrame([(i, "M", 1.0, 4.0, 8.0, 10.0, 12.0) for i in ids],
                               "entranceObjectId bigint, municipalityName string, kwh_per_year_for_1_panel double, "
                               "kwh_per_year_for_4_panel double, kwh_per_year_for_8_panel double, "
                               "kwh_per_year_for_10_panel double, kwh_per_year_for_12_panel double")
    got = {r.adoption: r["1_panel_total_mwh"] for r in adoption_totals(df, seed=seed).collect()}
    u = {i: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) % 10000 for i in ids}
    for p in (15, 30, 50, 100):
        n = sum(1 for i in ids if u[i] < p * 100)
        assert got.get(p, 0.0) == float(n)
    assert got[100] == float(len(ids))


import datetime as dt  # noqa: E402

from rooftop.operators.addresses import OUTPUT_COLUMNS, latest_addresses  # noqa: E402

_dates = st.one_of(st.none(), st.sampled_from([dt.datetime(2020, 1, 1), dt.datetime(2021, 6, 1),
                                               dt.datetime(2022, 3, 3)]))
_coord = st.sampled_from(["48.1", "17.2", "None", None])
_entrance = st.tuples(st.sampled_from(["811", "812", None]), _coord, _coord, st.integers(1, 6), _dates)
_building = st.tuples(st.integers(1, 6), st.sampled_from(["Rodinný dom", "Iná budova", "Garáž"]), _dates,
                      st.integers(1, 3), st.integers(1, 4))


def _brute(spark, e, b, m, entrance_ts):
    for name, df in (("e", e), ("b", b), ("m", m)):
        df.createOrReplaceTempView(f"p_{name}")
    ts = "e.changedAt" if entrance_ts else "b.changedAt"
    return spark.sql(f"""
      WITH j AS (
        SELECT e.objectId AS entranceObjectId, e.postalCode, nullif(e.axisB, 'None') AS axisB,
               nullif(e.axisL, 'None') AS axisL, b.objectId AS houseObjectId, b.buildingTypeName,
               {ts} AS changedAt, b.propertyRegistrationNumber, m.objectId AS addressObjectId, m.municipalityName
        FROM p_e e JOIN p_b b ON e.propertyRegistrationNumberIdentifier = b.objectId
                   JOIN p_m m ON b.municipalityIdentifier = m.objectId
        WHERE nullif(e.axisB, 'None') IS NOT NULL AND nullif(e.axisL, 'None') IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY postalCode, propertyRegistrationNumber, municipalityName,
                 buildingTypeName, houseObjectId, addressObjectId ORDER BY changedAt DESC NULLS LAST,
                 entranceObjectId) AS rn FROM j)
      SELECT entranceObjectId, postalCode, axisB, axisL, houseObjectId, buildingTypeName, changedAt,
             propertyRegistrationNumber, addressObjectId, municipalityName, 140 AS area
      FROM r WHERE rn = 1 AND buildingTypeName IN ('Rodinný dom', 'Iná budova')
        AND lower(municipalityName) LIKE '%bratislava%'""")


@settings(**SETTINGS)
@given(entrances=st.lists(_entrance, min_size=1, max_size=40), buildings=st.lists(_building, max_size=10),
       entrance_ts=st.booleans())
def test_latest_addresses_property(spark, entrances, buildings, entrance_ts):
    e_rows = [(i, pc, a, b, prn, ts) for i, (pc, a, b, prn, ts) in enumerate(entrances)]
    e = spark.createDataFrame(e_rows, "objectId bigint, postalCode string, axisB string, axisL string, "
                                      "propertyRegistrationNumberIdentifier bigint, changedAt timestamp_ntz")
    b = spark.createDataFrame(buildings, "objectId bigint, buildingTypeName string, changedAt timestamp_ntz, "
                                         "propertyRegistrationNumber bigint, municipalityIdentifier bigint")
    m = spark.createDataFrame([(1, "Bratislava I"), (2, "BRATISLAVA - Nové Mesto"), (3, "Senec")],
                              "objectId bigint, municipalityName string")
    if entrance_ts:
        b = b.drop("changedAt")
    else:
        e = e.drop("changedAt")
    got = sorted((tuple(r) for r in latest_addresses(e, b, m, limit=None).select(*OUTPUT_COLUMNS).collect()),
                 key=repr)
    want = sorted((tuple(r) for r in _brute(spark, e.withColumn("changedAt", F.lit(None).cast("timestamp_ntz"))
                                             if not entrance_ts else e, b, m, entrance_ts).collect()), key=repr)
    assert got == want


# -- aggregate-first operators against per-row brute force ----------------------
import hashlib as _hashlib  # noqa: E402

from rooftop.functions.formulas import Scenario  # noqa: E402
from rooftop.operators.emissions import emission_savings  # noqa: E402
from rooftop.operators.yields import YIELD_COLUMNS  # noqa: E402

vals = st.one_of(st.none(), st.floats(0, 5000, allow_nan=False).map(lambda x: round(x, 3)))


@settings(**SETTINGS)
@given(rows=st.lists(st.tuples(st.integers(0, 10**6), st.sampled_from(["A", "B", None]), vals), min_size=1,
                     max_size=60, unique_by=lambda t: t[0]), seed=st.integers(0, 5))
def test_adoption_totals_property(spark, rows, seed):
    data = [(i, m, v, None if v is None else v * 4, None, None, None) for i, m, v in rows]
    schema = "entranceObjectId bigint, municipalityName string, " + ", ".join(f"{c} double" for c in YIELD_COLUMNS)
    got = {(r.adoption, r.municipalityName): (r["1_panel_total_mwh"], r["4_panel_total_mwh"], r["8_panel_total_mwh"])
           for r in adoption_totals(spark.createDataFrame(data, schema), seed=seed).collect()}
    want = {}
    for p in (15, 30, 50, 100):
        for i, m, v in rows:
            u = int(_hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) % 10000
            if u < p * 100:
                a, b, c = want.get((p, m), (None, None, None))
                a = a if v is None else (v if a is None else a + v)
                b = b if v is None else (v * 4 if b is None else b + v * 4)
                want[(p, m)] = (a, b, None)
    assert set(got) == set(want)
    for k in want:
        for x, y in zip(got[k], want[k]):
            assert (x is None and y is None) or abs(x - y) < 1e-6


@settings(**SETTINGS)
@given(rows=st.lists(st.tuples(st.sampled_from(["A", "B", None]), vals), min_size=1, max_size=40),
       scen=st.lists(st.tuples(st.floats(0.05, 1.0), st.sampled_from([2000.0, 2500.0, 3000.0]),
                               st.floats(0, 20000), st.floats(0, 1)), min_size=1, max_size=4))
def test_emission_savings_property(spark, rows, scen):
    scenarios = [Scenario(f"s{j}", adoption=a, household_ykwh_average=avg, km_driven=km, solar_coverage=c)
                 for j, (a, avg, km, c) in enumerate(scen)]
    df = spark.createDataFrame(rows, "municipalityName string, possible_kwh_per_year_whole_roof double")
    got = {(r.municipalityName, r.scenario): r for r in emission_savings(df, scenarios).collect()}
    for s in scenarios:
        for m in {m for m, _ in rows}:
            ps = [p for mm, p in rows if mm == m]
            hs = [s.households * s.household_ykwh_average * min(1.0, p / s.household_ykwh_average)
                  * (s.zse_co2 - s.solar_co2) * s.adoption for p in ps if p is not None]
            km = s.households * s.cars_per_household * s.diesel_cars * s.adoption * s.km_driven
            car = km * s.diesel_co2 - km * s.solar_co2 * s.electric_km * s.solar_coverage \
                - km * s.zse_co2 * s.electric_km * (1 - s.solar_coverage)
            r = got[(m, s.name)]
            assert r.houses == len(ps)
            assert (r.household_co2_kg is None) == (not hs)
            if hs:
                assert abs(r.household_co2_kg - sum(hs)) < 1e-6 * max(1.0, abs(sum(hs)))
            assert abs(r.car_co2_kg - len(ps) * car) < 1e-6 * max(1.0, abs(len(ps) * car))
