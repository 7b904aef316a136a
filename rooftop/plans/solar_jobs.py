"""The table jobs of the rooftop-solar question, each bound to declared tables.

    raw registers --clean_*--> registers --addresses--> addresses
    addresses + replies --capacity--> capacity --adoption--> totals per level
                                          \\--roofs--> roofs --emissions--> CO2
    raw irradiance file --irradiance--> hourly files + total kWh

Every function takes the session and the table declarations; paths, formats
and credentials are the caller's.  Each job writes its outputs as tables, so
the next job starts from written data (lineage is cut at every table).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.formulas import Scenario
from ..operators.addresses import CITY, WANTED_BUILDING_TYPES, latest_addresses
from ..operators.adoption import ADOPTION_LEVELS, adoption_totals, adoption_totals_bernoulli, level_outputs
from ..operators.clean import clean_buildings, clean_entrances, clean_municipalities, typed_register
from ..operators.emissions import DEFAULT_SCENARIOS, emission_savings
from ..operators.exact_sample import adoption_totals_exact
from ..operators.nearest_point import attach_nearest_yield
from ..operators.roofs import roof_panels
from ..operators.yields import attach_yield, model_parameters, parse_yield_reports, yield_requests
from ..sources.catalogue import migrate_table, read_catalogue
from ..sources.irradiance import RAW_SCHEMA, process_raw_file
from ..sources.rejects import read_routed
from ..sources.tables import TableIn, TableOut
from .jobs import run_job


def clean_registers_job(spark: SparkSession, raw: Mapping[str, TableIn], out: Mapping[str, TableOut],
                        preview: int = 0) -> dict[str, DataFrame]:
    """Raw municipality / entrance / building exports -> clean registers.

    ``raw`` and ``out`` are keyed by ``municipalities``, ``entrances``, ``buildings``
    (any subset).
    """
    cleaners = {"municipalities": clean_municipalities, "entrances": clean_entrances, "buildings": clean_buildings}
    unknown = set(raw) - set(cleaners)
    if unknown:
        raise ValueError(f"unknown registers: {sorted(unknown)}")
    return run_job(spark, lambda s, **frames: {k: cleaners[k](typed_register(v, k)) for k, v in frames.items()},
                   dict(raw), {k: out[k] for k in raw}, preview=preview)


def addresses_job(spark: SparkSession, entrances: TableIn, buildings: TableIn, municipalities: TableIn,
                  out: TableOut, *, building_types: Sequence[str] | None = WANTED_BUILDING_TYPES,
                  city: str | None = CITY, limit: int | None = None,
                  top_n_strategy: str = "merge", preview: int = 0) -> dict[str, DataFrame]:
    return run_job(
        spark,
        lambda s, entrances, buildings, municipalities: latest_addresses(
            entrances, buildings, municipalities, building_types=building_types, city=city, limit=limit,
            top_n_strategy=top_n_strategy),
        {"entrances": entrances, "buildings": buildings, "municipalities": municipalities},
        {"out": out}, preview,
    )


def requests_job(spark: SparkSession, addresses: TableIn, out: TableOut, *, catalogue: TableIn | None = None,
                 model_name: str | None = None, endpoint: str | None = None, preview: int = 0) -> dict[str, DataFrame]:
    """One yield request per municipality.  With a catalogue and a model name the
    panel's kWp and technology come from the catalogue (defaults when unknown)."""
    kw = {}
    if catalogue is not None and model_name is not None:
        kw["kwp"], kw["pv_tech"] = model_parameters(catalogue.read(spark), model_name)
    return run_job(spark, lambda s, addresses: yield_requests(addresses, endpoint=endpoint, **kw),
                   {"addresses": addresses}, {"out": out}, preview)


def capacity_job(spark: SparkSession, addresses: TableIn, replies: TableIn, out: TableOut,
                 preview: int = 0) -> dict[str, DataFrame]:
    """Addresses + yield replies (municipalityName, body) -> capacity table."""
    return run_job(
        spark,
        lambda s, addresses, replies: attach_yield(addresses, parse_yield_reports(replies.select(
            "municipalityName", "body"))),
        {"addresses": addresses, "replies": replies},
        {"out": out}, preview,
    )


def adoption_job(spark: SparkSession, capacity: TableIn, outputs: Mapping[int, TableOut] | TableOut, *,
                 levels: Sequence[int] = ADOPTION_LEVELS, keyed: bool = True, seed: int = 0, exact: bool = False,
                 preview: int = 0) -> dict[str, DataFrame]:
    """Totals per adoption level: one table partitioned by ``adoption``, or one table per level.

    Households are drawn by keyed, nested shares, by independent ones (not
    ``keyed``), or in exact numbers of each municipality (``exact``).
    """
    def fn(s, capacity):
        if exact:
            totals = adoption_totals_exact(capacity, levels, seed=seed)
        else:
            totals = adoption_totals(capacity, levels, seed=seed) if keyed else \
                adoption_totals_bernoulli(capacity, levels, seed=seed)
        if not isinstance(outputs, Mapping):
            return totals
        return level_outputs(totals, {p: f"level_{p}" for p in outputs})

    outs = {f"level_{p}": t for p, t in outputs.items()} if isinstance(outputs, Mapping) else {"out": outputs}
    return run_job(spark, fn, {"capacity": capacity}, outs, preview)


def roofs_job(spark: SparkSession, capacity: TableIn, out: TableOut,
              areas: Sequence[int] | None = None, preview: int = 0) -> dict[str, DataFrame]:
    return run_job(spark, lambda s, capacity: roof_panels(capacity, areas), {"capacity": capacity}, {"out": out}, preview)


def emissions_job(spark: SparkSession, roofs: TableIn, out: TableOut,
                  scenarios: Sequence[Scenario] | TableIn = DEFAULT_SCENARIOS, preview: int = 0) -> dict[str, DataFrame]:
    """``scenarios``: records, or a table of them as a second input of the job."""
    if isinstance(scenarios, TableIn):
        return run_job(spark, lambda s, roofs, scenarios: emission_savings(roofs, scenarios),
                       {"roofs": roofs, "scenarios": scenarios}, {"out": out}, preview)
    return run_job(spark, lambda s, roofs: emission_savings(roofs, scenarios), {"roofs": roofs}, {"out": out}, preview)


def nearest_yield_job(spark: SparkSession, addresses: TableIn, replies: TableIn, out: TableOut,
                      preview: int = 0) -> dict[str, DataFrame]:
    """Addresses + replies of requested points (request_id, lat, lon, body) -> capacity table by the nearest point."""
    return run_job(
        spark,
        lambda s, addresses, replies: attach_nearest_yield(addresses, parse_yield_reports(replies.select(
            "request_id", "lat", "lon", "body"))),
        {"addresses": addresses, "replies": replies}, {"out": out}, preview)


def readings_job(spark: SparkSession, raw: TableIn, good: TableOut, rejects: TableOut,
                 schema: str = RAW_SCHEMA) -> dict[str, int]:
    """Raw logger file -> readings of the schema, and the rows that are not with their reasons; rows by reason."""
    routed = read_routed(spark, raw, schema, required=["epoch", "watts"])
    run_job(spark, lambda s: {"good": routed.good, "rejects": routed.rejects}, {}, {"good": good, "rejects": rejects})
    return dict(routed.counts)


def catalogue_job(spark: SparkSession, raw_path: str, out: TableOut) -> DataFrame:
    """Catalogue CSV (one row per model, name in ``index``) -> catalogue table with ``panel_name``."""
    out.write(read_catalogue(spark, raw_path))
    return out.as_input().read(spark)


def approved_panels_job(spark: SparkSession, raw: TableIn, out: TableOut) -> DataFrame:
    """Copy of the approved-panel list."""
    return migrate_table(spark, raw, out)


def irradiance_job(spark: SparkSession, raw_path: str, epoch_path: str, label_path: str,
                   tz: str = "UTC") -> DataFrame:
    """Raw logger file -> two hourly files; returns the total kWh (one row)."""
    return process_raw_file(spark, raw_path, epoch_path, label_path, tz)
