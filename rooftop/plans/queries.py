"""The registered query set: each name has a Spark builder and, where the
operation is expressible in SQL, an equivalent DuckDB query (the oracle).

Builders take ``(spark, sf_dir)`` and read the driver's whole tables through
the stand-in bindings of ``standins``.  Computed doubles that are sums of many
terms are rounded on both sides (the engines add in different orders).
"""

from __future__ import annotations

from datetime import date
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import PANEL_FOOTPRINT_M2, PV_TECH_CODES, tech_code
from ..functions.text import normalise_model_name, nullif_sentinel, repair_text
from ..operators.addresses import latest_addresses
from ..operators.adoption import ADOPTION_LEVELS, adoption_totals, adoption_totals_bernoulli, total_column
from ..operators.clean import clean_register
from ..operators.emissions import DEFAULT_SCENARIOS, emission_savings
from ..operators.irradiance import hourly_irradiance, local_time, total_kwh
from ..operators.numbering import global_row_number
from ..operators.roofs import default_roof_areas, roof_panels
from ..operators.yields import (
    YIELD_COLUMNS,
    attach_yield,
    match_catalogue,
    parse_yield_reports,
    representatives,
    yield_requests,
)
from ..session import scratch_path
from ..sources.catalogue import models_to_rows, read_catalogue
from ..sources.irradiance import read_hourly_file, read_raw_readings, write_hourly_files
from ..sources.tables import NTZ_MICROS_FORMAT, Format, SaveMode, TableIn, TableOut
from ..streaming.hourly import hourly_irradiance_stream, read_stream_files, run_to_end
from . import standins as S
from .registry import ORACLE_SQL, QUERIES, register
from .solar_jobs import adoption_job, approved_panels_job

def _round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# ---------------------------------------------------------------------------
# Addresses (flagship)
# ---------------------------------------------------------------------------
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest address rows, dated by the building's versions (the original job's case)."""
    return latest_addresses(
        S.entrances(spark, sf_dir).drop("changedAt"), S.buildings(spark, sf_dir), S.municipalities(spark, sf_dir),
        building_types=S.STANDIN_BUILDING_TYPES, city=S.STANDIN_CITY,
    )


register("address_latest", S.ADDRESSES_SQL)(addresses)


@register("address_entrance_dates", S.ENTRANCE_DATED_SQL)
def q_address_entrance_dates(spark, sf_dir):
    """The same where only the entrances carry a date."""
    return latest_addresses(
        S.entrances(spark, sf_dir), S.buildings(spark, sf_dir).drop("changedAt"), S.municipalities(spark, sf_dir),
        building_types=S.STANDIN_BUILDING_TYPES, city=S.STANDIN_CITY)


TOP_ROWS = 50


@register("address_top_n", f"{S.ADDRESSES_SQL}\nORDER BY {S.ADDRESS_ORDER_SQL}\nLIMIT {TOP_ROWS}")
def q_address_top_n(spark, sf_dir):
    """The first rows of the ordered addresses, cut in distributed levels (O1 O2)."""
    return latest_addresses(
        S.entrances(spark, sf_dir).drop("changedAt"), S.buildings(spark, sf_dir), S.municipalities(spark, sf_dir),
        building_types=S.STANDIN_BUILDING_TYPES, city=S.STANDIN_CITY, limit=TOP_ROWS, top_n_strategy="tree")


def sql_double(x: float) -> str:
    """A DuckDB DOUBLE literal with the exact value of the Python float."""
    s = repr(float(x))
    return s if ("e" in s or "inf" in s or "nan" in s) else s + "e0"


def _sql_case_map(col: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"coalesce(CASE {col} {whens} END, '{default}')"


YEAR_SQL = r"(Year\s+)(\d+.\d+)"


def _yearly_energy_sql(body: str) -> str:
    return f"try_cast(regexp_extract({body}, '{YEAR_SQL}', 2) AS DOUBLE) / 1000e0"


# ---------------------------------------------------------------------------
# Register cleaning
# ---------------------------------------------------------------------------


@register("sentinel_ts", """
SELECT o_orderkey,
       try_cast(nullif(CASE WHEN o_orderstatus = 'P' THEN 'None' ELSE CAST(o_orderdate AS VARCHAR) END, 'None')
                AS TIMESTAMP) AS changedAt,
       try_cast(nullif(CASE WHEN o_orderpriority = '1-URGENT' THEN 'not a date'
                            ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END, 'None') AS TIMESTAMP) AS validFrom,
       try_cast(nullif(CASE WHEN o_orderstatus = 'F' THEN 'None' END, 'None') AS TIMESTAMP) AS validTo
FROM orders""")
def q_sentinel_ts(spark, sf_dir):
    """Text timestamps with 'None', junk and NULL -> TIMESTAMP_NTZ."""
    o = S.table(spark, sf_dir, "orders")
    raw = o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.lit("None"))
        .otherwise(F.col("o_orderdate").cast("string")).alias("changedAt"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("not a date"))
        .otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("validFrom"),
        F.when(F.col("o_orderstatus") == "F", F.lit("None")).alias("validTo"),
    )
    return clean_register(raw, ("changedAt", "validFrom", "validTo"))


@register("nonnull_points", f"""
WITH e AS ({S.ENTRANCES_SQL})
SELECT objectId, nullif(axisB, 'None') AS axisB, nullif(axisL, 'None') AS axisL
FROM e WHERE nullif(axisB, 'None') IS NOT NULL AND nullif(axisL, 'None') IS NOT NULL""")
def q_nonnull_points(spark, sf_dir):
    """Coordinates with the 'None' sentinel -> NULL, rows with both kept."""
    e = S.entrances(spark, sf_dir)
    return e.select("objectId", nullif_sentinel("axisB").alias("axisB"), nullif_sentinel("axisL").alias("axisL")) \
        .filter(F.col("axisB").isNotNull() & F.col("axisL").isNotNull())


@register("text_repair", """
SELECT p_partkey,
       replace(p_name, 'a', 'Ăˇ') AS damaged_name,
       replace(replace(p_name, 'a', 'Ăˇ'), 'Ăˇ', 'á') AS repaired_name
FROM part""")
def q_text_repair(spark, sf_dir):
    """Damaged letter (UTF-8 read as Windows-1250) repaired."""
    p = S.table(spark, sf_dir, "part")
    damaged = F.replace(F.col("p_name"), F.lit("a"), F.lit("Ăˇ"))
    return p.select("p_partkey", damaged.alias("damaged_name"), repair_text(damaged).alias("repaired_name"))


@register("rename_project", """
SELECT c_custkey AS houseObjectId, c_mktsegment AS buildingTypeName, c_nationkey AS municipalityIdentifier,
       CAST(140 AS INTEGER) AS area
FROM customer""")
def q_rename_project(spark, sf_dir):
    """Projection on read, alias, rename, drop by reference, literal column.

    ``TableIn(columns=...)`` does the same projection on read (tested in test_tables)."""
    c = S.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return (c.select(F.col("c_custkey").alias("houseObjectId"), "c_mktsegment", "c_nationkey", "c_acctbal")
            .withColumnRenamed("c_mktsegment", "buildingTypeName")
            .withColumnRenamed("c_nationkey", "municipalityIdentifier")
            .drop(c["c_acctbal"])
            .withColumn("area", F.lit(140)))


# ---------------------------------------------------------------------------
# Catalogue, technology, model names
# ---------------------------------------------------------------------------
_NORMALISE_SQL = "regexp_replace(regexp_replace({x}, '\\(.*\\) ', '', 'g'), '[.\\-\\s]', '_', 'g')"


@register("name_normalise", f"""
WITH r AS ({S.RAW_MODEL_NAMES_SQL})
SELECT p_partkey, raw_name, {_NORMALISE_SQL.format(x='raw_name')} AS panel_name FROM r""")
def q_name_normalise(spark, sf_dir):
    """Model name normalisation: strip '(..) ', separators to '_' (F4)."""
    r = S.raw_model_names(spark, sf_dir)
    return r.select("p_partkey", "raw_name", normalise_model_name("raw_name").alias("panel_name"))


@register("tech_code", f"""
SELECT p_partkey, {S._technology_sql('p_type')} AS Technology,
       {_sql_case_map(S._technology_sql('p_type'), PV_TECH_CODES, 'crystSi')} AS pv_tech
FROM part""")
def q_tech_code(spark, sf_dir):
    """Technology name -> service code through a literal map, default crystSi."""
    p = S.table(spark, sf_dir, "part")
    t = S.technology_col()
    return p.select("p_partkey", t.alias("Technology"), tech_code(t).alias("pv_tech"))


def _catalogue_match_sql(request: str = "request_name", fold: str = "{}") -> str:
    starts = f"starts_with({fold.format('c.panel_name')}, {fold.format('r.request_name')})"
    return f"""
WITH c AS ({S.CATALOGUE_SQL}),
     r0 AS ({S.MODEL_REQUESTS_SQL}),
     r AS (SELECT DISTINCT {request} AS request_name FROM r0),
     m AS (SELECT r.request_name, c.panel_name, c.STC, c.Technology,
                  row_number() OVER (PARTITION BY r.request_name
                                     ORDER BY c.panel_name, c.STC, c.Technology) AS rn
           FROM r JOIN c ON {starts})
SELECT r.request_name, m.panel_name,
       coalesce(m.STC / 1000e0, {sql_double(0.346)}) AS kwp,
       {_sql_case_map('m.Technology', PV_TECH_CODES, 'crystSi')} AS pv_tech
FROM r LEFT JOIN m ON r.request_name = m.request_name AND m.rn = 1"""


@register("catalogue_match", _catalogue_match_sql())
def q_catalogue_match(spark, sf_dir):
    """First catalogue model starting with the requested name, else defaults."""
    return match_catalogue(S.model_requests(spark, sf_dir), S.catalogue(spark, sf_dir))


@register("catalogue_match_any_case", _catalogue_match_sql("upper(request_name)", "lower({})"))
def q_catalogue_match_any_case(spark, sf_dir):
    """The same without regard to case."""
    requests = S.model_requests(spark, sf_dir).select(F.upper("request_name").alias("request_name")).distinct()
    return match_catalogue(requests, S.catalogue(spark, sf_dir), case_sensitive=False)


# ---------------------------------------------------------------------------
# Yield replies, requests, capacity
# ---------------------------------------------------------------------------
@register("report_parse", f"""
WITH r AS ({S.PAGE_REPLIES_SQL})
SELECT page_id, {_yearly_energy_sql('body')} AS kwh_per_year_for_1_panel FROM r""")
def q_report_parse(spark, sf_dir):
    """Yearly energy out of whole reply texts; NULL without the 'Year' line."""
    return parse_yield_reports(S.page_replies(spark, sf_dir))


@register("representative", f"""
WITH a AS ({S.ADDRESSES_SQL}),
     r AS (SELECT *, row_number() OVER (PARTITION BY municipalityName ORDER BY entranceObjectId) AS rn FROM a)
SELECT * EXCLUDE (rn) FROM r WHERE rn = 1""")
def q_representative(spark, sf_dir):
    """One address per municipality, smallest entrance id (A3)."""
    return representatives(addresses(spark, sf_dir))


def _request_sql(lat: str, lon: str, kwp: str, pv_tech: str) -> str:
    """The request text as a SQL concatenation."""
    from ..functions.formulas import REQUEST_TEMPLATE
    values = {"lat": lat, "lon": lon, "kwp": f"CAST({kwp} AS VARCHAR)", "pv_tech": pv_tech}
    parts = []
    for text, field, _, _ in Formatter().parse(REQUEST_TEMPLATE):
        parts += [f"'{text}'"] + ([values[field]] if field else [])
    return " || ".join(parts)


_REPRESENTATIVES_SQL = f"""
WITH a AS ({S.ADDRESSES_SQL}),
     r AS (SELECT *, row_number() OVER (PARTITION BY municipalityName ORDER BY entranceObjectId) AS rn FROM a)"""


@register("yield_requests", f"""{_REPRESENTATIVES_SQL}
SELECT municipalityName, axisB, axisL, {sql_double(0.346)} AS kwp, 'crystSi' AS pv_tech,
       {_request_sql('axisB', 'axisL', sql_double(0.346), "'crystSi'")} AS request
FROM r WHERE rn = 1""")
def q_yield_requests(spark, sf_dir):
    """One yield request text per municipality."""
    return yield_requests(addresses(spark, sf_dir))


@register("yield_requests_models", f"""{_REPRESENTATIVES_SQL},
     q AS ({S.MUNICIPALITY_MODELS_SQL}),
     c AS ({S.CATALOGUE_SQL}),
     m AS (SELECT q.municipalityName, c.STC, c.Technology,
                  row_number() OVER (PARTITION BY q.municipalityName ORDER BY c.panel_name, c.STC, c.Technology) AS rn
           FROM q JOIN c ON starts_with(c.panel_name, q.request_name)),
     p AS (SELECT q.municipalityName, coalesce(m.STC / 1000e0, {sql_double(0.346)}) AS kwp,
                  {_sql_case_map('m.Technology', PV_TECH_CODES, 'crystSi')} AS pv_tech
           FROM q LEFT JOIN m ON q.municipalityName = m.municipalityName AND m.rn = 1),
     x AS (SELECT r.municipalityName, axisB, axisL, coalesce(p.kwp, {sql_double(0.346)}) AS kwp,
                  coalesce(p.pv_tech, 'crystSi') AS pv_tech
           FROM r LEFT JOIN p ON r.municipalityName = p.municipalityName WHERE r.rn = 1)
SELECT *, {_request_sql('axisB', 'axisL', 'kwp', 'pv_tech')} AS request FROM x""")
def q_yield_requests_models(spark, sf_dir):
    """Requests with the power and technology of each municipality's catalogue model."""
    models = match_catalogue(S.municipality_models(spark, sf_dir), S.catalogue(spark, sf_dir))
    return yield_requests(addresses(spark, sf_dir), models=models)


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with per-panel yields of their municipality (the capacity table)."""
    yields = parse_yield_reports(S.municipality_replies(spark, sf_dir))
    return attach_yield(addresses(spark, sf_dir), yields)


CAPACITY_SQL = f"""
WITH a AS ({S.ADDRESSES_SQL}),
     y AS (SELECT municipalityName, max({_yearly_energy_sql('body')}) AS k FROM ({S.MUNICIPALITY_REPLIES_SQL})
           GROUP BY municipalityName)
SELECT a.*, y.k AS kwh_per_year_for_1_panel, y.k * 4 AS kwh_per_year_for_4_panel,
       y.k * 8 AS kwh_per_year_for_8_panel, y.k * 10 AS kwh_per_year_for_10_panel,
       y.k * 12 AS kwh_per_year_for_12_panel
FROM a LEFT JOIN y ON a.municipalityName = y.municipalityName"""

register("attach_yield", CAPACITY_SQL)(capacity)


# ---------------------------------------------------------------------------
# Adoption levels
# ---------------------------------------------------------------------------
def _adoption_sql(independent_from: int | None = None) -> str:
    """One draw for all levels (seed 0), or with a seed one draw per level, of seed + i for the i-th."""
    sums = ", ".join(
        f'round(sum({c}), 6) AS "{c.removeprefix("kwh_per_year_for_").removesuffix("_panel")}_panel_total_mwh"'
        for c in YIELD_COLUMNS)
    seeds = [0 if independent_from is None else independent_from + i for i in range(len(ADOPTION_LEVELS))]
    levels = ", ".join(f"{{'p': {p}, 'seed': '{s}:'}}" for p, s in zip(ADOPTION_LEVELS, seeds))
    return f"""
WITH cap AS ({CAPACITY_SQL}),
     l AS (SELECT *, unnest([{levels}]) AS level FROM cap),
     d AS (SELECT *, level.p AS adoption,
                  CAST(('0x' || substr(md5(level.seed || CAST(entranceObjectId AS VARCHAR)), 1, 8)) AS BIGINT) % 10000
                  AS u FROM l),
     x AS (SELECT * FROM d WHERE u < adoption * 100)
SELECT adoption, municipalityName, {sums}
FROM x GROUP BY adoption, municipalityName"""


def _rounded_totals(totals: DataFrame) -> DataFrame:
    return _round(totals, {total_column(c): 6 for c in YIELD_COLUMNS})


@register("adoption_totals", _adoption_sql())
def q_adoption_totals(spark, sf_dir):
    """Keyed nested samples 15/30/50/100 %, yield sums per municipality in one pass (A1 A4 K8)."""
    return _rounded_totals(adoption_totals(capacity(spark, sf_dir)))


@register("adoption_sampled", _adoption_sql(42))
def q_adoption_sampled(spark, sf_dir):
    """Independent Bernoulli sample per level, as the original job (A4)."""
    return _rounded_totals(adoption_totals_bernoulli(capacity(spark, sf_dir), seed=42))


@register("adoption_tables", _adoption_sql(42))
def q_adoption_tables(spark, sf_dir):
    """One job that writes each level to a table of its own; the four read back."""
    src = TableOut(scratch_path(spark, "capacity"), mode=SaveMode.OVERWRITE, build_datetime=False)
    src.write(capacity(spark, sf_dir))
    outs = {p: TableOut(scratch_path(spark, f"adoption-{p}"), mode=SaveMode.OVERWRITE, build_datetime=False)
            for p in ADOPTION_LEVELS}
    adoption_job(spark, src.as_input(), outs, keyed=False, seed=42)
    parts = [t.as_input().read(spark).withColumn("adoption", F.lit(p)) for p, t in outs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _rounded_totals(out)


# ---------------------------------------------------------------------------
# Numbering and roofs
# ---------------------------------------------------------------------------
@register("global_index", """
SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders""")
def q_global_index(spark, sf_dir):
    """Global row number by key without a single-partition window."""
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return global_row_number(o, "o_orderkey", out="rn")


@register("global_index_text", """
SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name NULLS FIRST, c_custkey NULLS FIRST) AS rn
FROM customer""")
def q_global_index_text(spark, sf_dir):
    """Global row number by a text key with a tie-break: range partitions, no window."""
    c = S.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return global_row_number(c, "c_name", out="rn", tiebreak=["c_custkey"])


@register("global_index_skewed", """
WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 7
                                   WHEN o_orderkey % 1000 = 5 THEN o_orderkey * 1000000000000
                                   ELSE o_orderkey END AS k FROM orders)
SELECT *, row_number() OVER (ORDER BY k NULLS FIRST, o_orderkey NULLS FIRST) AS rn FROM k""")
def q_global_index_skewed(spark, sf_dir):
    """Numbering by a key with many NULLs, one value in a third of the rows, and far outliers."""
    key = F.when(F.col("o_orderkey") % 3 == 1, F.lit(7)) \
        .when(F.col("o_orderkey") % 1000 == 5, F.col("o_orderkey") * F.lit(1_000_000_000_000)) \
        .when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey"))
    # the first condition that holds counts, as in the SQL: multiples of three are NULL
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, key).alias("k"))
    return global_row_number(o, "k", out="rn", tiebreak=["o_orderkey"])


def _roofs_sql() -> str:
    areas = ", ".join(str(a) for a in default_roof_areas())
    fp = sql_double(PANEL_FOOTPRINT_M2)
    return f"""
WITH cap AS ({CAPACITY_SQL}),
     n AS (SELECT * EXCLUDE (area),
                  row_number() OVER (ORDER BY entranceObjectId NULLS FIRST, postalCode NULLS FIRST,
                                     propertyRegistrationNumber NULLS FIRST, municipalityName NULLS FIRST,
                                     buildingTypeName NULLS FIRST, houseObjectId NULLS FIRST,
                                     addressObjectId NULLS FIRST) AS rn
           FROM cap),
     a AS (SELECT * EXCLUDE (rn), ([{areas}])[(rn % {len(default_roof_areas())}) + 1] AS area FROM n)
SELECT *, {fp} AS panel_area,
       CAST(floor(CAST(area AS DOUBLE) / {fp}) AS BIGINT) AS possible_panel_count,
       kwh_per_year_for_1_panel * CAST(floor(CAST(area AS DOUBLE) / {fp}) AS BIGINT)
         AS possible_kwh_per_year_whole_roof
FROM a"""


ROOFS_SQL = _roofs_sql()


@register("roof_panels", ROOFS_SQL)
def q_roof_panels(spark, sf_dir):
    """Roof area by row number modulo list, panels per roof, whole-roof yield."""
    # the capacity plan is read three times by the numbering: checkpoint it once
    return roof_panels(capacity(spark, sf_dir), materialize=True)


# ---------------------------------------------------------------------------
# Irradiance
# ---------------------------------------------------------------------------
_HOUR_SQL = "date_trunc('hour', ts)"


@register("hourly_mean", f"""
SELECT {_HOUR_SQL} AS hour, CAST(epoch({_HOUR_SQL}) AS BIGINT) AS "timestamp",
       strftime({_HOUR_SQL}, '%d/%m/%Y, %H:%M:%S') AS label,
       round(avg(value), 6) AS wats_per_meter
FROM events GROUP BY {_HOUR_SQL}""")
def q_hourly_mean(spark, sf_dir):
    """Readings folded to local hours: mean, epoch and label."""
    return _round(hourly_irradiance(S.readings(spark, sf_dir)), {"wats_per_meter": 6})


def _total_kwh_sql() -> str:
    from ..functions import formulas as FM
    factor = (f"* {FM.SECONDS_IN_HOUR} / {FM.READING_INTERVAL_S} * {sql_double(FM.MODULE_EFFICIENCY)} "
              f"* {sql_double(FM.MODULE_AREA_M2)} * {FM.MODULE_COUNT}")
    return f"""
WITH h AS (SELECT avg(value) AS w FROM events GROUP BY {_HOUR_SQL})
SELECT round(sum(w {factor} / 1000e0), 3) AS total_kwh FROM h"""


@register("total_kwh", _total_kwh_sql())
def q_total_kwh(spark, sf_dir):
    """Energy of all hourly means in kWh."""
    return _round(total_kwh(hourly_irradiance(S.readings(spark, sf_dir))), {"total_kwh": 3})


# ---------------------------------------------------------------------------
# Emissions
# ---------------------------------------------------------------------------
def _emissions_sql() -> str:
    from dataclasses import asdict

    def struct(sc) -> str:
        return "{" + ", ".join(f"'{k}': " + (f"'{v}'" if isinstance(v, str) else sql_double(v))
                               for k, v in asdict(sc).items()) + "}"

    averages = {sc.household_ykwh_average for sc in DEFAULT_SCENARIOS}
    assert len(averages) == 1, "the oracle is written for one household average"
    avg = sql_double(averages.pop())
    scenarios = "[" + ", ".join(struct(sc) for sc in DEFAULT_SCENARIOS) + "]"
    car_km = "(s.households * s.cars_per_household * s.diesel_cars * s.adoption) * s.km_driven"
    car = (f"{car_km} * s.diesel_co2 - {car_km} * s.solar_co2 * s.electric_km * s.solar_coverage"
           f" - {car_km} * s.zse_co2 * s.electric_km * (1e0 - s.solar_coverage)")
    house = "s.households * s.household_ykwh_average * cov_sum * (s.zse_co2 - s.solar_co2) * s.adoption"
    return f"""
WITH r AS ({ROOFS_SQL}),
     a AS (SELECT municipalityName, count(*) AS houses, sum(p) AS production_kwh,
                  sum(CASE WHEN p > {avg} THEN 1e0 ELSE p / {avg} END) AS cov_sum
           FROM (SELECT municipalityName, possible_kwh_per_year_whole_roof AS p FROM r)
           GROUP BY municipalityName),
     e AS (SELECT *, unnest({scenarios}) AS s FROM a),
     x AS (SELECT municipalityName, s.name AS scenario, houses, production_kwh,
                  {house} AS h, CAST(houses AS DOUBLE) * ({car}) AS c FROM e)
SELECT municipalityName, scenario, houses,
       round(production_kwh, 6) AS production_kwh,
       round(h, 6) AS household_co2_kg,
       round(c, 6) AS car_co2_kg,
       round(coalesce(h, 0e0) + c, 6) AS total_co2_kg
FROM x"""


@register("emissions", _emissions_sql())
def q_emissions(spark, sf_dir):
    """CO2 savings per municipality and scenario."""
    out = emission_savings(roof_panels(capacity(spark, sf_dir), materialize=True))
    # stand-in yields have 5 decimals: rounding at 6 never meets an exact tie
    return _round(out, {c: 6 for c in ("production_kwh", "household_co2_kg", "car_co2_kg", "total_co2_kg")})


# ---------------------------------------------------------------------------
# Sources and sinks: write a table, read it back (whole tables)
# ---------------------------------------------------------------------------

EVENTS_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
EVENTS_SQL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


def _roundtrip(fmt: Format):
    def build(spark, sf_dir):
        src = S.table(spark, sf_dir, "events")
        opts = {} if fmt is Format.PARQUET else {"timestampNTZFormat": NTZ_MICROS_FORMAT}
        out = TableOut(scratch_path(spark, f"events-{fmt.value}"), format=fmt, mode=SaveMode.OVERWRITE,
                       build_datetime=False, options=opts)
        out.write(src)
        schema = None if fmt is Format.PARQUET else EVENTS_DDL
        return out.read_back(spark, **({"schema": schema} if schema else {})).select(*src.columns)
    build.__doc__ = f"Write events as {fmt.value}, read it back with its schema (sources and sinks)."
    return build


for _fmt in (Format.CSV, Format.JSON, Format.PARQUET):
    register(f"roundtrip_{_fmt.value}", EVENTS_SQL)(_roundtrip(_fmt))


@register("catalogue_load", f"SELECT c.*, CAST(p_size AS VARCHAR) AS size FROM ({S.CATALOGUE_SQL}) c "
          "JOIN part ON ends_with(panel_name, '_' || CAST(p_partkey AS VARCHAR)) "
          "AND starts_with(panel_name, p_brand || '_')")
def q_catalogue_load(spark, sf_dir):
    """Catalogue CSV with shuffled and extra columns, read by name, all attributes kept."""
    path = scratch_path(spark, "catalogue")
    size = S.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"))
    cat = S.catalogue(spark, sf_dir).withColumn("_key", F.substring_index("panel_name", "_", -1).cast("bigint"))
    rows = cat.join(size, F.col("_key") == F.col("p_partkey")).select(
        "Technology", "size", F.col("panel_name").alias("index"), "STC")
    TableOut(path, format=Format.CSV, mode=SaveMode.OVERWRITE, build_datetime=False).write(rows)
    return read_catalogue(spark, path)


@register("catalogue_transposed", f"""
SELECT p_brand AS panel_name, CAST(max(p_retailprice) AS VARCHAR) AS "STC", min({S._technology_sql('p_type')}) AS "Technology"
FROM part GROUP BY p_brand""")
def q_catalogue_transposed(spark, sf_dir):
    """An attribute-per-row, model-per-column file turned around (S9); a brand's figures stand for a model."""
    p = S.table(spark, sf_dir, "part")
    brands = p.groupBy("p_brand").agg(F.max("p_retailprice").cast("string").alias("STC"),
                                      F.min(S.technology_col()).alias("Technology"))
    wide = brands.unpivot("p_brand", ["STC", "Technology"], "attribute", "value") \
        .groupBy("attribute").pivot("p_brand").agg(F.first("value"))
    path = scratch_path(spark, "catalogue-wide")
    TableOut(path, format=Format.CSV, mode=SaveMode.OVERWRITE, build_datetime=False).write(wide)
    return models_to_rows(TableIn(path, format=Format.CSV, infer_schema=False).read(spark), "attribute",
                          ["STC", "Technology"])


@register("approved_copy", "SELECT * FROM supplier")
def q_approved_copy(spark, sf_dir):
    """Copy of a table as it is by the approved-panel job, read back."""
    out = TableOut(scratch_path(spark, "approved"), mode=SaveMode.OVERWRITE, build_datetime=False)
    approved_panels_job(spark, TableIn(f"{sf_dir.rstrip('/')}/supplier.parquet"), out)
    return out.as_input().read(spark)


@register("projected_read", "SELECT c_custkey, c_nationkey FROM customer")
def q_projected_read(spark, sf_dir):
    """Projection declared with the input."""
    return TableIn(f"{sf_dir.rstrip('/')}/customer.parquet", columns=("c_custkey", "c_nationkey")).read(spark)


@register("inferred_csv", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def q_inferred_csv(spark, sf_dir):
    """CSV written and read back with its types inferred."""
    out = TableOut(scratch_path(spark, "part-csv"), format=Format.CSV, mode=SaveMode.OVERWRITE, build_datetime=False)
    out.write(S.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"))
    back = out.as_input().read(spark)
    return back.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@register("read_back_missing", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_read_back_missing(spark, sf_dir):
    """A first run reads back what is not there yet as empty, then what it wrote."""
    n = S.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    out = TableOut(scratch_path(spark, "nation-history"), mode=SaveMode.APPEND, build_datetime=False)
    before = out.read_back(spark, schema=n.schema)
    out.write(before.unionByName(n))
    return out.read_back(spark, schema=n.schema)


def _hourly_paths(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Raw logger CSV (epoch, watts) folded to the two hourly CSVs: their paths, by epoch and by label."""
    ev = S.table(spark, sf_dir, "events")
    epoch0 = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    raw = ev.select((F.timestamp_diff("MICROSECOND", epoch0, F.col("ts")) / F.lit(1e6)).alias("epoch"),
                    F.col("value").alias("watts"))
    raw_path = scratch_path(spark, "irradiance-raw")
    TableOut(raw_path, format=Format.CSV, mode=SaveMode.OVERWRITE, build_datetime=False).write(raw)
    hourly = hourly_irradiance(read_raw_readings(spark, raw_path, schema="epoch double, watts double"))
    epoch_path, label_path = scratch_path(spark, "irradiance-hourly"), scratch_path(spark, "irradiance-labels")
    write_hourly_files(hourly, epoch_path, label_path)
    return epoch_path, label_path


@register("irradiance_files", f"""
SELECT CAST(epoch({_HOUR_SQL}) AS BIGINT) AS "timestamp", round(avg(value), 6) AS wats_per_meter
FROM events GROUP BY {_HOUR_SQL}""")
def q_irradiance_files(spark, sf_dir):
    """Raw logger CSV (epoch, watts) -> hourly CSVs by epoch and by label -> read back by epoch."""
    return _round(read_hourly_file(spark, _hourly_paths(spark, sf_dir)[0]), {"wats_per_meter": 6})


@register("irradiance_labels", f"""
SELECT strftime({_HOUR_SQL}, '%d/%m/%Y, %H:%M:%S') AS "timestamp", round(avg(value), 6) AS wats_per_meter
FROM events GROUP BY {_HOUR_SQL}""")
def q_irradiance_labels(spark, sf_dir):
    """The same, the label-keyed file read back (K7)."""
    return _round(read_hourly_file(spark, _hourly_paths(spark, sf_dir)[1], labelled=True), {"wats_per_meter": 6})


LOCAL_ZONE = "Europe/Bratislava"


def _local_hours_sql() -> str:
    """Hours of central European local time: two hours ahead between the last Sundays of March and October, 01:00 UTC."""
    def last_sunday(month: int) -> str:
        end = f"make_date(year(t)::INT, {month}, 31)"
        return f"CAST({end} - CAST(dayofweek({end}) AS INT) AS TIMESTAMP) + INTERVAL 1 HOUR"

    return f"""
WITH e AS (SELECT value, ts + to_days(CAST(date_diff('day', (SELECT min(ts) FROM events),
                                           make_timestamp(2024, 10, 15, 0, 0, 0)) AS INT)) AS t FROM events),
     l AS (SELECT value, date_trunc('hour', t + CASE WHEN t >= {last_sunday(3)} AND t < {last_sunday(10)}
                                                     THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END) AS h FROM e)
SELECT h AS hour, strftime(h, '%d/%m/%Y, %H:%M:%S') AS label, round(avg(value), 6) AS wats_per_meter
FROM l GROUP BY h"""


@register("hourly_mean_local", _local_hours_sql())
def q_hourly_mean_local(spark, sf_dir):
    """Epoch readings folded to local hours across the end of summer time, whose repeated hour is one."""
    ev = S.table(spark, sf_dir, "events").select("ts", "value")
    epoch0 = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    first = ev.agg(F.min(F.col("ts").cast("date"))).first()[0]
    days = (date(2024, 10, 15) - first).days if first else 0
    epoch = F.timestamp_diff("MICROSECOND", epoch0, F.col("ts")) / F.lit(1e6) + F.lit(days * 86400)
    local = ev.select(local_time(epoch, LOCAL_ZONE).alias("ts"), F.col("value").alias("watts"))
    return _round(hourly_irradiance(local, tz=LOCAL_ZONE).select("hour", "label", "wats_per_meter"), {"wats_per_meter": 6})


@register("stamp_partition", EVENTS_SQL)
def q_stamp_partition(spark, sf_dir):
    """Partitioned CSV write with the build stamp, read back (K1 K3 K6, partitionBy for CSV).

    ``events`` is written partitioned by ``event_type`` and ``build_datetime``
    (added by the stamp), read back with partition discovery, and compared
    without the stamp (its value is the time of the write).
    """
    src = S.table(spark, sf_dir, "events")
    out = TableOut(scratch_path(spark, "events-stamped"), format=Format.CSV, mode=SaveMode.OVERWRITE,
                   partition_by="event_type", build_datetime=True,
                   options={"timestampNTZFormat": NTZ_MICROS_FORMAT})
    out.write(src)
    back = out.read_back(spark, schema="event_id bigint, ts timestamp_ntz, user_id bigint, value double, "
                                       "props string, event_type string, build_datetime timestamp")
    return back.select(*src.columns)


@register("append_job", """
SELECT * FROM customer
UNION ALL
SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'""")
def q_append_job(spark, sf_dir):
    """Declared job runs with path checks and save modes.

    ``customer`` is copied by a job (overwrite), the BUILDING segment is
    appended by a second job, and an ignore-mode write of another table must
    leave the output unchanged.
    """
    from .jobs import run_job

    src = TableIn(f"{sf_dir.rstrip('/')}/customer.parquet")
    path = scratch_path(spark, "customer-copy")
    run_job(spark, lambda s, customer: customer, {"customer": src},
            {"out": TableOut(path, mode=SaveMode.OVERWRITE, build_datetime=False)})
    run_job(spark, lambda s, customer: customer.filter(F.col("c_mktsegment") == "BUILDING"), {"customer": src},
            {"out": TableOut(path, mode=SaveMode.APPEND, build_datetime=False)})
    TableOut(path, mode=SaveMode.IGNORE, build_datetime=False).write(S.table(spark, sf_dir, "nation"))
    return TableIn(path).read(spark)


# ---------------------------------------------------------------------------
# Streaming form of the hourly fold
# ---------------------------------------------------------------------------


@register("hourly_mean_stream", f"""
SELECT {_HOUR_SQL} AS hour, CAST(epoch({_HOUR_SQL}) AS BIGINT) AS "timestamp",
       strftime({_HOUR_SQL}, '%d/%m/%Y, %H:%M:%S') AS label,
       round(avg(value), 6) AS wats_per_meter
FROM events
GROUP BY {_HOUR_SQL}""")
def q_hourly_mean_stream(spark, sf_dir):
    """Readings as a file stream, 1-hour watermark, update mode, availableNow, all hours (R1 streaming)."""
    stream = read_stream_files(spark, sf_dir.rstrip("/"), EVENTS_DDL, name_glob="events.parquet")
    hourly = hourly_irradiance_stream(stream.select("ts", F.col("value").alias("watts")))
    # the state is the few hourly windows still open (lateness / 1 hour + 1), whatever the volume
    out = run_to_end(hourly, scratch_path(spark, "hourly-stream"), scratch_path(spark, "hourly-stream-ckpt"),
                     state_partitions=8)
    return _round(out, {"wats_per_meter": 6})


from . import upkeep_queries  # noqa: E402,F401 - registers the queries on deliveries, builds and upkeep

__all__ = ["ORACLE_SQL", "QUERIES"]
