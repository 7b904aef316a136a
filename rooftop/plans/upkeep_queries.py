"""Registered queries on deliveries, builds, upkeep, exact samples, irregular readings, rejects and coordinates.

As in ``queries``, every query reads the driver's whole tables through the
stand-ins and has a DuckDB query beside it.
"""

from __future__ import annotations

import contextlib
import io
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import Scenario
from ..operators.addresses import latest_addresses
from ..operators.adoption import ADOPTION_LEVELS
from ..operators.emissions import emission_savings
from ..operators.exact_sample import adoption_totals_exact
from ..operators.intervals import time_weighted_hours
from ..operators.irradiance import hourly_irradiance
from ..operators.nearest_point import attach_nearest_yield
from ..operators.roofs import roof_panels
from ..operators.upkeep import KeyedStore, affected_houses, refreshed_addresses
from ..operators.yields import YIELD_COLUMNS, parse_yield_reports, yield_column
from ..session import scratch_path
from ..sources.builds import AppendOnceTable, StampedTable
from ..sources.deliveries import Deliveries
from ..sources.irradiance import RAW_SCHEMA, read_raw_readings
from ..sources.rejects import Routed, read_routed
from ..sources.tables import NTZ_MICROS_FORMAT, Format, SaveMode, TableIn, TableOut
from ..streaming.hourly import hourly_irradiance_stream, read_stream_files, run_to_end
from . import queries as Q
from . import standins as S
from .jobs import CyclicDependencyError, PathCollisionError, table_job
from .registry import register
from .solar_jobs import clean_registers_job


# ---------------------------------------------------------------------------
# Deliveries of different schemas
# ---------------------------------------------------------------------------
@register("deliveries_merged", """
SELECT o_orderkey, o_custkey::BIGINT AS o_custkey, o_totalprice::DOUBLE AS o_totalprice,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 3 = 2 THEN o_orderdate ELSE date_trunc('day', o_orderdate) END AS o_orderdate
FROM orders""")
def q_deliveries_merged(spark, sf_dir):
    """Three deliveries of one register that differ in columns and types, in two formats, read as one table.

    The first has a narrow key, prices as float and dates without time, and no
    priority; the second adds the priority and status; the third, as CSV, has no
    status.  One of them is delivered twice, which adds nothing.
    """
    o = S.table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate").alias("o_orderdate")
    part = [o.filter(F.col("o_orderkey") % 3 == i) for i in range(3)]
    first = part[0].select(F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int"), "o_totalprice", day)
    second = part[1].select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", day)
    third = part[2].select("o_orderkey", F.col("o_custkey").cast("int"), "o_totalprice", "o_orderpriority", "o_orderdate")
    table = Deliveries(scratch_path(spark, "deliveries"))
    table.deliver(first, "2024-01")
    table.deliver(second, "2024-02")
    table.deliver(third, "2024-03", Format.CSV, {"timestampNTZFormat": NTZ_MICROS_FORMAT})
    table.deliver(second, "2024-02")
    return table.read(spark).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate")


# ---------------------------------------------------------------------------
# Builds (K6, K3) and appends that count once (K5)
# ---------------------------------------------------------------------------
@register("read_as_of", """
WITH b AS (SELECT *, TIMESTAMP '2024-03-01 06:00:00' AS first, TIMESTAMP '2024-03-02 06:00:00' AS second FROM orders)
SELECT '2024-03-01' AS as_of, o_orderkey, o_totalprice, o_orderstatus, first AS build FROM b
UNION ALL
SELECT '2024-03-03', o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice * 2 ELSE o_totalprice END,
       o_orderstatus, CASE WHEN o_orderstatus IN ('F', 'O') THEN second ELSE first END FROM b""")
def q_read_as_of(spark, sf_dir):
    """Two builds, the second of some partitions only, and a third that failed before its end, read as of two times.

    Every row comes with the stamp of its build (K3 K6).
    """
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    table = StampedTable(scratch_path(spark, "builds"), "o_orderstatus")
    table.write(o, datetime(2024, 3, 1, 6))
    table.write(o.filter(F.col("o_orderstatus").isin("F", "O")).withColumn("o_totalprice", F.col("o_totalprice") * 2),
                datetime(2024, 3, 2, 6))
    table.write_data(o.withColumn("o_totalprice", F.lit(0.0)), datetime(2024, 3, 2, 18))
    out = None
    for day in (1, 3):
        rows = table.read(spark, o.schema, datetime(2024, 3, day, 12)).select(
            F.lit(f"2024-03-0{day}").alias("as_of"), *o.columns, F.col("build_datetime").cast("timestamp_ntz").alias("build"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("append_once", """
SELECT c_custkey, c_name, c_mktsegment FROM customer
UNION ALL
SELECT c_custkey + 1000000000, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'""")
def q_append_once(spark, sf_dir):
    """Two append jobs, one of them run three times and a failed attempt left behind: each job's rows once (K5)."""
    c = S.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    more = c.filter(F.col("c_mktsegment") == "BUILDING").withColumn("c_custkey", F.col("c_custkey") + F.lit(1_000_000_000))
    table = AppendOnceTable(scratch_path(spark, "append-once"))
    table.write_data(more, "afailed")
    done = [table.append(c, "load"), table.append(more, "extend"), table.append(more, "extend"), table.append(c, "load")]
    if done != [True, True, False, False]:
        raise RuntimeError(f"runs counted: {done}")
    return table.read(spark, c.schema)


# ---------------------------------------------------------------------------
# Upkeep by changes (A2)
# ---------------------------------------------------------------------------
GONE_FROM = 10_000_000_000


def _yesterday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entrances of the delivery before: some not there yet, some other, some that are gone since."""
    e = S.entrances(spark, sf_dir)
    k = F.col("objectId") % 50
    before = e.filter(k != 0).withColumns({
        "axisB": F.when(k == 1, F.concat(F.coalesce("axisB", F.lit("")), F.lit("9"))).otherwise(F.col("axisB")),
        "propertyRegistrationNumberIdentifier": F.when(k == 3, F.col("propertyRegistrationNumberIdentifier") + 1)
        .otherwise(F.col("propertyRegistrationNumberIdentifier"))})
    gone = e.filter(k == 2).withColumn("objectId", F.col("objectId") + F.lit(GONE_FROM))
    return before.unionByName(gone)


def _entrance_store(spark: SparkSession, sf_dir: str) -> KeyedStore:
    store = KeyedStore(scratch_path(spark, "entrance-store"), ["objectId"])
    store.write(_yesterday(spark, sf_dir).drop("changedAt"))
    return store


@register("register_changes", f"""
WITH e AS ({S.ENTRANCES_SQL})
SELECT CASE objectId % 50 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' WHEN 3 THEN 'changed' ELSE 'same' END AS change,
       objectId, axisB, propertyRegistrationNumberIdentifier AS building FROM e
UNION ALL
SELECT 'gone', objectId + {GONE_FROM}, axisB, propertyRegistrationNumberIdentifier FROM e WHERE objectId % 50 = 2""")
def q_register_changes(spark, sf_dir):
    """Each entrance of the stored and the delivered register as new, changed, gone or same (A2 upkeep)."""
    changes = _entrance_store(spark, sf_dir).changes(S.entrances(spark, sf_dir).drop("changedAt"))
    row = F.coalesce("after", "before")
    return changes.select("change", row["objectId"].alias("objectId"), row["axisB"].alias("axisB"),
                          row["propertyRegistrationNumberIdentifier"].alias("building"))


@register("addresses_by_delta", S.ADDRESSES_SQL)
def q_addresses_by_delta(spark, sf_dir):
    """The stored addresses of yesterday's register brought up to today's by its changes: equal to a full rebuild (A2)."""
    options = {"building_types": S.STANDIN_BUILDING_TYPES, "city": S.STANDIN_CITY}
    buildings, municipalities = S.buildings(spark, sf_dir), S.municipalities(spark, sf_dir)
    store = _entrance_store(spark, sf_dir)
    kept = TableOut(scratch_path(spark, "addresses-stored"), mode=SaveMode.OVERWRITE, build_datetime=False)
    kept.write(latest_addresses(store.read(spark), buildings, municipalities, **options))
    changes = store.changes(S.entrances(spark, sf_dir).drop("changedAt"))
    noted = TableOut(scratch_path(spark, "entrance-changes"), mode=SaveMode.OVERWRITE, build_datetime=False)
    noted.write(changes)
    changes = noted.as_input().read(spark)
    return refreshed_addresses(kept.as_input().read(spark), affected_houses(changes), store.updated(changes), buildings,
                               municipalities, **options)


# ---------------------------------------------------------------------------
# Exact samples (A4)
# ---------------------------------------------------------------------------
def _exact_sql() -> str:
    sums = ", ".join(f'round(sum({c}), 6) AS "{Q.total_column(c)}"' for c in YIELD_COLUMNS)
    levels = ", ".join(map(str, ADOPTION_LEVELS))
    return f"""
WITH cap AS ({Q.CAPACITY_SQL}),
     d AS (SELECT *, CAST('0x' || substr(md5('0:' || CAST(entranceObjectId AS VARCHAR)), 1, 15) AS BIGINT) AS u FROM cap),
     r AS (SELECT *, row_number() OVER (PARTITION BY municipalityName ORDER BY u, entranceObjectId) AS rn,
                  count(*) OVER (PARTITION BY municipalityName) AS n FROM d),
     l AS (SELECT *, unnest([{levels}]) AS adoption FROM r)
SELECT adoption, municipalityName, count(*) AS households, {sums}
FROM l WHERE rn <= (2 * adoption * n + 100) // 200 GROUP BY adoption, municipalityName"""


@register("adoption_exact", _exact_sql())
def q_adoption_exact(spark, sf_dir):
    """Totals of exactly round(p n) households of each municipality (A4), cuts found by counting."""
    return Q._rounded_totals(adoption_totals_exact(Q.capacity(spark, sf_dir)))


@register("adoption_exact_refined", _exact_sql())
def q_adoption_exact_refined(spark, sf_dir):
    """The same where a bucket with over ten rows is counted again by finer ones."""
    return Q._rounded_totals(adoption_totals_exact(Q.capacity(spark, sf_dir), ranked_rows=10))


# ---------------------------------------------------------------------------
# Irregular readings
# ---------------------------------------------------------------------------
_HELD_SQL = """
WITH r AS (SELECT ts, value, lag(ts) OVER (ORDER BY ts, event_id) AS start FROM events),
     h AS (SELECT *, greatest(start, date_trunc('hour', ts)) AS cut FROM r
           WHERE start IS NOT NULL AND ts > start AND epoch_us(ts) - epoch_us(start) <= 3600000000),
     p AS (SELECT date_trunc('hour', ts) AS hour, value, epoch_us(ts) - epoch_us(cut) AS us FROM h
           UNION ALL
           SELECT date_trunc('hour', start), value, epoch_us(cut) - epoch_us(start) FROM h)"""


@register("time_weighted_hours", f"""{_HELD_SQL}
SELECT hour, CAST(epoch(hour) AS BIGINT) AS "timestamp", strftime(hour, '%d/%m/%Y, %H:%M:%S') AS label,
       round(sum(us) / 1e6, 6) AS covered_s, round(sum(value * us) / sum(us), 6) AS wats_per_meter
FROM p WHERE us > 0 GROUP BY hour""")
def q_time_weighted_hours(spark, sf_dir):
    """Hourly means over time: a reading counts since the one before, over all hours and files (A5)."""
    ev = S.table(spark, sf_dir, "events").select("ts", "value", "event_id")
    return Q._round(time_weighted_hours(ev, value="value", tiebreak=["event_id"]), {"covered_s": 6, "wats_per_meter": 6})


# ---------------------------------------------------------------------------
# A stream with repeated deliveries
# ---------------------------------------------------------------------------
@register("hourly_mean_stream_repeated", f"""
SELECT {Q._HOUR_SQL} AS hour, CAST(epoch({Q._HOUR_SQL}) AS BIGINT) AS "timestamp",
       strftime({Q._HOUR_SQL}, '%d/%m/%Y, %H:%M:%S') AS label, round(avg(value), 6) AS wats_per_meter
FROM events GROUP BY {Q._HOUR_SQL}""")
def q_hourly_mean_stream_repeated(spark, sf_dir):
    """The readings delivered twice, whole, and every third a third time, in batches of one file: each counts once."""
    ev = S.table(spark, sf_dir, "events").select("event_id", "ts", "value")
    inbox = scratch_path(spark, "inbox")
    for n, again in enumerate((ev, ev, ev.filter(F.col("event_id") % 3 == 0))):
        TableOut(f"{inbox}/delivery={n}", mode=SaveMode.ERROR, build_datetime=False).write(again)
    stream = read_stream_files(spark, inbox, "event_id bigint, ts timestamp_ntz, value double", max_files_per_trigger=1)
    # the deliveries span a month, so ids are held for two
    hourly = hourly_irradiance_stream(stream, value="value", lateness="60 days", unique=["event_id"])
    out = run_to_end(hourly, scratch_path(spark, "repeated-stream"), scratch_path(spark, "repeated-stream-ckpt"),
                     state_partitions=8)
    return Q._round(out, {"wats_per_meter": 6})


# ---------------------------------------------------------------------------
# Rejected rows
# ---------------------------------------------------------------------------
# A line of the raw file is damaged by the event's id: what is wrong, and the reason it is rejected for.
_LINE_SQL = """
SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch, CAST(floor(value) AS BIGINT) AS watts,
       CASE WHEN event_id % 97 = 1 THEN 'fields' WHEN event_id % 97 IN (2, 3, 4) THEN 'type' WHEN event_id % 97 = 5 THEN 'missing'
            WHEN event_id % 97 = 6 THEN 'negative' END AS reason FROM events"""


def _raw_lines(spark: SparkSession, sf_dir: str) -> str:
    """The readings as a logger file with damaged lines; its path."""
    epoch0 = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ev = S.table(spark, sf_dir, "events").select(
        "event_id", F.floor(F.timestamp_diff("MICROSECOND", epoch0, F.col("ts")) / F.lit(1_000_000)).cast("string").alias("epoch"),
        F.floor("value").cast("string").alias("watts"))
    kind = F.col("event_id") % 97
    line = F.when(kind == 1, F.col("epoch")) \
        .when(kind == 2, F.concat_ws(",", "epoch", F.lit("n/a"))) \
        .when(kind == 3, F.concat_ws(",", F.lit("no time"), F.col("watts"))) \
        .when(kind == 4, F.concat_ws(",", "epoch", F.lit("99999999999"))) \
        .when(kind == 5, F.concat_ws(",", "epoch", F.lit(""))) \
        .when(kind == 6, F.concat_ws(",", "epoch", F.concat(F.lit("-1"), F.col("watts")))) \
        .otherwise(F.concat_ws(",", "epoch", "watts"))
    path = scratch_path(spark, "raw-lines")
    ev.select(line.alias("value")).write.text(path)
    return path


def _routed(spark: SparkSession, sf_dir: str) -> Routed:
    source = TableIn(_raw_lines(spark, sf_dir), format=Format.CSV, header=False)
    return read_routed(spark, source, RAW_SCHEMA, required=["epoch", "watts"], checks={"negative": F.col("watts") >= 0})


@register("readings_accepted", f"SELECT epoch::DOUBLE AS epoch, watts::INTEGER AS watts FROM ({_LINE_SQL}) WHERE reason IS NULL")
def q_readings_accepted(spark, sf_dir):
    """Rows of a logger file with damaged lines that are of the file's own integer schema."""
    return _routed(spark, sf_dir).good


@register("readings_rejected", f"""
SELECT reason, CASE WHEN event_id % 97 IN (2, 4, 5) THEN 'watts' WHEN event_id % 97 = 3 THEN 'epoch' END AS "column",
       CASE event_id % 97 WHEN 3 THEN 'no time' ELSE epoch::VARCHAR END AS epoch,
       CASE event_id % 97 WHEN 1 THEN NULL WHEN 2 THEN 'n/a' WHEN 4 THEN '99999999999' WHEN 5 THEN NULL
            WHEN 6 THEN '-1' || watts ELSE watts::VARCHAR END AS watts,
       CASE event_id % 97 WHEN 1 THEN epoch::VARCHAR END AS raw
FROM ({_LINE_SQL}) WHERE reason IS NOT NULL""")
def q_readings_rejected(spark, sf_dir):
    """The other rows of that file, as text, each with its reason."""
    return _routed(spark, sf_dir).rejects


@register("readings_counted", f"SELECT coalesce(reason, 'good') AS reason, count(*) AS n FROM ({_LINE_SQL}) GROUP BY ALL")
def q_readings_counted(spark, sf_dir):
    """Rows by reason, observed while the file is routed."""
    counts = _routed(spark, sf_dir).counts
    return spark.createDataFrame([(r, int(n)) for r, n in counts.items() if n], "reason string, n bigint")


# ---------------------------------------------------------------------------
# The nearest reply by coordinates
# ---------------------------------------------------------------------------
# A reply's point: spread by its page's number over the addresses' ranges.
_POINT_SQL = """48e0 + (page_id * 7919 % 15013) / 10e0 AS lat, 17e0 + (page_id * 104729 % 15017) / 10e0 AS lon"""


def requested_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the reply of a requested point."""
    pages = S.page_replies(spark, sf_dir)
    return parse_yield_reports(pages.select(
        F.col("page_id").alias("request_id"),
        (F.lit(48.0) + (F.col("page_id") * 7919 % 15013) / F.lit(10.0)).alias("lat"),
        (F.lit(17.0) + (F.col("page_id") * 104729 % 15017) / F.lit(10.0)).alias("lon"), "body"))


def spread_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses with coordinates spread by their ids (those of the stand-in lie on a line)."""
    return Q.addresses(spark, sf_dir).withColumns({
        "axisB": (F.lit(48.0) + (F.col("houseObjectId") * 31 % 15000) / F.lit(10.0)).cast("string"),
        "axisL": (F.lit(17.0) + (F.col("entranceObjectId") * 17 % 15000) / F.lit(10.0)).cast("string")})


@register("nearest_yield", f"""
WITH a AS (SELECT * REPLACE (48e0 + (houseObjectId * 31 % 15000) / 10e0 AS axisB,
                             17e0 + (entranceObjectId * 17 % 15000) / 10e0 AS axisL) FROM ({S.ADDRESSES_SQL})),
     y AS (SELECT page_id AS id, {_POINT_SQL}, {Q._yearly_energy_sql('body')} AS k FROM ({S.PAGE_REPLIES_SQL})),
     n AS (SELECT a.entranceObjectId, a.houseObjectId, a.axisB, a.axisL,
                  arg_min({{'id': y.id, 'k': y.k}}, {{'d': (a.axisB - y.lat) * (a.axisB - y.lat) + (a.axisL - y.lon) * (a.axisL - y.lon),
                                                   'id': y.id}}) AS p,
                  min((a.axisB - y.lat) * (a.axisB - y.lat) + (a.axisL - y.lon) * (a.axisL - y.lon)) AS d
           FROM a, y WHERE y.k IS NOT NULL GROUP BY ALL)
SELECT entranceObjectId, houseObjectId, p.id AS request_id, round(sqrt(d), 6) AS distance,
       p.k AS kwh_per_year_for_1_panel, p.k * 12 AS kwh_per_year_for_12_panel FROM n""")
def q_nearest_yield(spark, sf_dir):
    """Each address takes the yield of the nearest requested point that has one."""
    near = attach_nearest_yield(spread_addresses(spark, sf_dir), requested_points(spark, sf_dir))
    return near.select("entranceObjectId", "houseObjectId", "request_id", F.round("request_id_distance", 6).alias("distance"),
                       yield_column(1), yield_column(12))


# ---------------------------------------------------------------------------
# Scenario table
# ---------------------------------------------------------------------------
_SCENARIO_TABLE_SQL = """SELECT n_name AS name, (n_nationkey + 1) / 25e0 AS population_treshold,
       CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 500e0 END AS km_driven,
       CASE n_nationkey % 3 WHEN 0 THEN NULL ELSE 2000e0 + 250e0 * (n_nationkey % 3) END AS household_ykwh_average FROM nation"""


def scenario_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scenario per nation, under the original calculator's column names; NULL means the default."""
    k = F.col("n_nationkey")
    return S.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), ((k + 1) / F.lit(25.0)).alias("population_treshold"),
        F.when(k % 2 == 0, k * F.lit(500.0)).alias("km_driven"), F.lit(3.0).alias("cars"),
        F.when(k % 3 != 0, F.lit(2000.0) + F.lit(250.0) * (k % 3)).alias("household_ykwh_average"))


def _emissions_table_sql() -> str:
    d = Scenario("default", adoption=0.0)
    lit = Q.sql_double
    car_km = f"{lit(d.households)} * {lit(d.cars_per_household)} * {lit(d.diesel_cars)} * adoption * km"
    car = (f"{car_km} * {lit(d.diesel_co2)} - {car_km} * {lit(d.solar_co2)} * {lit(d.electric_km)} * {lit(d.solar_coverage)}"
           f" - {car_km} * {lit(d.zse_co2)} * {lit(d.electric_km)} * (1e0 - {lit(d.solar_coverage)})")
    house = f"{lit(d.households)} * average * cov * ({lit(d.zse_co2)} - {lit(d.solar_co2)}) * adoption"
    return f"""
WITH r AS ({Q.ROOFS_SQL}),
     s AS (SELECT name, population_treshold AS adoption, coalesce(km_driven, {lit(d.km_driven)}) AS km,
                  coalesce(household_ykwh_average, {lit(d.household_ykwh_average)}) AS average FROM ({_SCENARIO_TABLE_SQL})),
     a AS (SELECT municipalityName, average, count(*) AS houses, sum(p) AS production_kwh,
                  sum(CASE WHEN p > average THEN 1e0 ELSE p / average END) AS cov
           FROM (SELECT municipalityName, possible_kwh_per_year_whole_roof AS p FROM r), (SELECT DISTINCT average FROM s)
           GROUP BY ALL),
     x AS (SELECT municipalityName, name AS scenario, houses, production_kwh, {house} AS h,
                  CAST(houses AS DOUBLE) * ({car}) AS c FROM a JOIN s USING (average))
SELECT municipalityName, scenario, houses, round(production_kwh, 6) AS production_kwh, round(h, 6) AS household_co2_kg,
       round(c, 6) AS car_co2_kg, round(coalesce(h, 0e0) + c, 6) AS total_co2_kg FROM x"""


@register("emissions_table", _emissions_table_sql())
def q_emissions_table(spark, sf_dir):
    """CO2 savings for the scenarios of a table, three household averages among them."""
    out = emission_savings(roof_panels(Q.capacity(spark, sf_dir), materialize=True), scenario_table(spark, sf_dir))
    return Q._round(out, {c: 6 for c in ("production_kwh", "household_co2_kg", "car_co2_kg", "total_co2_kg")})


# ---------------------------------------------------------------------------
# The raw registers cleaned by one job (P6-P8, S1), and a decorated job
# ---------------------------------------------------------------------------
@register("clean_registers", """
SELECT 'building' AS register, c_custkey AS objectId, try_cast(c_nationkey AS BIGINT) AS link,
       replace('byt a ' || c_name, 'a', 'á') AS purpose,
       CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE TIMESTAMP '2024-02-03 04:05:06.789' END AS changedAt
FROM customer
UNION ALL
SELECT 'entrance', CASE WHEN o_orderkey % 41 <> 7 THEN o_orderkey END, o_custkey, o_orderstatus || '01',
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END FROM orders
UNION ALL
SELECT 'municipality', n_nationkey, NULL, n_name, NULL FROM nation""")
def q_clean_registers(spark, sf_dir):
    """Three raw CSV exports, all text, to typed and repaired registers by the cleaning job."""
    c, o, n = (S.table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    k = F.col("c_custkey") % 3
    none = F.lit("None")
    raw = {
        "buildings": c.select(
            F.col("c_custkey").cast("string").alias("objectId"), F.col("c_nationkey").cast("string").alias("municipalityIdentifier"),
            F.replace(F.concat(F.lit("byt a "), "c_name"), F.lit("a"), F.lit("Ăˇ")).alias("buildingPurposeName"),
            F.when(k == 0, none).when(k == 1, F.lit("soon")).otherwise(F.lit("2024-02-03 04:05:06.789")).alias("changedAt"),
            none.alias("validFrom"), none.alias("validTo")),
        "entrances": o.select(
            F.when(F.col("o_orderkey") % 41 == 7, F.lit("x1")).otherwise(F.col("o_orderkey").cast("string")).alias("objectId"),
            F.concat("o_orderstatus", F.lit("01")).alias("postalCode"),
            F.col("o_custkey").cast("string").alias("propertyRegistrationNumberIdentifier"),
            F.when(F.col("o_orderkey") % 5 == 0, none).otherwise(F.col("o_orderdate").cast("string")).alias("changedAt"),
            none.alias("validFrom"), none.alias("validTo"), none.alias("verifiedAt")),
        "municipalities": n.select(F.col("n_nationkey").cast("string").alias("objectId"), F.col("n_name").alias("municipalityName"),
                                   none.alias("changedAt"), none.alias("validFrom"), none.alias("validTo")),
    }
    ins, outs = {}, {}
    for name, df in raw.items():
        path = scratch_path(spark, f"raw-{name}")
        TableOut(path, format=Format.CSV, mode=SaveMode.OVERWRITE, build_datetime=False).write(df)
        ins[name] = TableIn(path, format=Format.CSV, infer_schema=False)
        outs[name] = TableOut(scratch_path(spark, name), mode=SaveMode.OVERWRITE, build_datetime=False)
    clean_registers_job(spark, ins, outs)
    clean = {name: t.as_input().read(spark) for name, t in outs.items()}

    def row(df: DataFrame, register: str, link, purpose: str) -> DataFrame:
        return df.select(F.lit(register).alias("register"), "objectId", link.cast("bigint").alias("link"),
                         F.col(purpose).alias("purpose"), "changedAt")
    return row(clean["buildings"], "building", F.col("municipalityIdentifier"), "buildingPurposeName") \
        .unionByName(row(clean["entrances"], "entrance", F.col("propertyRegistrationNumberIdentifier"), "postalCode")) \
        .unionByName(row(clean["municipalities"], "municipality", F.lit(None), "municipalityName"))


@register("decorated_job", "SELECT s_nationkey, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1")
def q_decorated_job(spark, sf_dir):
    """A decorated job with a preview; jobs with colliding or cyclic paths stop before any read."""
    out = TableOut(scratch_path(spark, "decorated"), mode=SaveMode.OVERWRITE, build_datetime=False)

    @table_job(out, supplier=TableIn(f"{sf_dir.rstrip('/')}/supplier.parquet"))
    def balances(spark, supplier):
        return supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))

    nowhere = TableIn(scratch_path(spark, "not-there"))
    for error, job in ((PathCollisionError, table_job(out, a=nowhere, b=nowhere)(lambda s, a, b: a)),
                       (CyclicDependencyError, table_job(TableOut(nowhere.path), a=nowhere)(lambda s, a: a))):
        try:
            job(spark)
        except error:
            continue
        raise RuntimeError(f"a job that should stop with {error.__name__} did not")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):  # a query prints nothing
        balances(spark, preview=3)
    if "balance" not in shown.getvalue():
        raise RuntimeError("the job showed no rows")
    return out.as_input().read(spark)


# ---------------------------------------------------------------------------
# The logger's own integer schema
# ---------------------------------------------------------------------------
@register("irradiance_raw", """
SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS "timestamp", round(avg(floor(value)), 6) AS wats_per_meter
FROM events GROUP BY 1""")
def q_irradiance_raw(spark, sf_dir):
    """A raw logger CSV of whole watts, read by its own schema, folded to hours."""
    epoch0 = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    raw = S.table(spark, sf_dir, "events").select(
        (F.timestamp_diff("MICROSECOND", epoch0, F.col("ts")) / F.lit(1e6)).alias("epoch"), F.floor("value").alias("watts"))
    path = scratch_path(spark, "irradiance-whole")
    TableOut(path, format=Format.CSV, mode=SaveMode.OVERWRITE, build_datetime=False).write(raw)
    hourly = hourly_irradiance(read_raw_readings(spark, path))
    return Q._round(hourly.select("timestamp", "wats_per_meter"), {"wats_per_meter": 6})
