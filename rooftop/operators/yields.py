"""Yield per panel by municipality: requests, catalogue match, replies, attach.

The per-row HTTP call of the original job is re-aimed as tables:

* ``representatives``  one address per municipality (smallest entrance id);
* ``match_catalogue``  first catalogue model whose name starts with the
  requested name, else the default panel (0.346 kWp, crystSi);
* ``yield_requests``   one request text per municipality;
* ``parse_yield_reports`` yearly energy out of the reply texts (fetching the
  replies is outside this library);
* ``attach_yield``     per-panel yield and its multiples joined to every
  address of the municipality.

Naming note: the value is the report's yearly energy / 1000 and is named
``kwh_per_year_for_N_panel``, as the tables downstream expect.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import fresh_name
from ..functions.formulas import (
    DEFAULT_KWP,
    DEFAULT_PV_TECH,
    PANEL_COUNTS,
    REQUEST_TEMPLATE,
    kwp_from_stc,
    tech_code,
)
from ..functions.text import normalise_model_name, yearly_energy
from .addresses import first_per_key


def yield_column(n: int) -> str:
    return f"kwh_per_year_for_{n}_panel"


YIELD_COLUMNS: tuple[str, ...] = tuple(yield_column(n) for n in PANEL_COUNTS)


# ---------------------------------------------------------------------------
def representatives(addresses: DataFrame, key: str = "municipalityName",
                    order_by: str = "entranceObjectId") -> DataFrame:
    """One row per ``key``: the row with the smallest ``order_by`` (ties: rest of the row).

    ``row_number() = 1`` with a partial WindowGroupLimit before the shuffle,
    so a municipality holding a third of all addresses leaves each task as
    one row.
    """
    rest = [c for c in addresses.columns if c not in (key, order_by)]
    order = [F.col(order_by).asc_nulls_last()] + [F.col(c).asc_nulls_first() for c in rest]
    return first_per_key(addresses, [key], order).select(key, order_by, *rest)


# ---------------------------------------------------------------------------
def match_catalogue(
    requests: DataFrame,
    catalogue: DataFrame,
    name: str = "request_name",
    *,
    case_sensitive: bool = True,
    default_kwp: float = DEFAULT_KWP,
    default_tech: str = DEFAULT_PV_TECH,
) -> DataFrame:
    """First catalogue row (by ``panel_name``) whose name starts with the request.

    Adds ``panel_name`` (NULL when nothing matches), ``kwp`` and ``pv_tech``.

    No request x catalogue pairs are formed.  Only prefixes of a length that
    some request has can answer one, so each catalogue name is expanded to those
    prefixes alone (the distinct lengths, at most the longest name's, are read
    first) and reduced with ``min`` per prefix: a combinable aggregate, so a
    prefix that most of the catalogue shares is reduced map side.  The answers,
    one per prefix, join the requests by equality.  Exact: the first name
    starting with ``p`` is the minimum over the names that have ``p`` as a prefix.
    """
    norm = (lambda c: c) if case_sensitive else F.lower
    prefix, found_model = (fresh_name(requests.columns, c) for c in ("_prefix", "_m"))
    model = F.struct(F.col("panel_name"), F.col("STC"), F.col("Technology"))
    keyed = requests.withColumn(prefix, norm(F.col(name)))
    lengths = sorted(r["n"] for r in keyed.select(F.length(prefix).alias("n")).distinct().collect()
                     if r["n"] is not None)
    first = catalogue.select(norm(F.col("panel_name")).alias("_key_src"), model.alias("_m")) \
        .select("_key_src", "_m", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("_len")) \
        .filter(F.col("_len") <= F.length("_key_src")) \
        .select(F.expr("substring(_key_src, 1, _len)").alias(prefix), "_m") \
        .groupBy(prefix).agg(F.min("_m").alias(found_model))
    found, m = keyed.join(first, prefix, "left"), F.col(found_model)
    return found.select(
        *requests.columns,
        m["panel_name"].alias("panel_name"),
        F.coalesce(kwp_from_stc(m["STC"]), F.lit(default_kwp)).alias("kwp"),
        F.when(m.isNull(), F.lit(default_tech)).otherwise(tech_code(m["Technology"])).alias("pv_tech"),
    )


# ---------------------------------------------------------------------------
def request_text(lat: str | Column, lon: str | Column, kwp: str | Column, pv_tech: str | Column,
                 endpoint: str | None = None) -> Column:
    """Query text of a yield request; prefixed by ``endpoint + '?'`` when given."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x

    values = {"lat": c(lat), "lon": c(lon), "kwp": c(kwp).cast("string"), "pv_tech": c(pv_tech)}
    parts = []
    for text, field, _, _ in Formatter().parse(REQUEST_TEMPLATE):
        parts.append(F.lit(text))
        if field:
            parts.append(values[field])
    if endpoint:
        parts.insert(0, F.lit(endpoint.rstrip("?") + "?"))
    return F.concat(*parts)


def yield_requests(
    addresses: DataFrame,
    *,
    kwp: float = DEFAULT_KWP,
    pv_tech: str = DEFAULT_PV_TECH,
    models: DataFrame | None = None,
    endpoint: str | None = None,
) -> DataFrame:
    """One request per municipality from its representative address.

    Power and technology come from ``kwp``/``pv_tech`` or, when ``models`` is
    given, from that table keyed by ``municipalityName`` (columns ``kwp``,
    ``pv_tech``, e.g. the output of ``match_catalogue``); municipalities
    without a model row get the parameters.
    """
    rep = representatives(addresses.select("municipalityName", "entranceObjectId", "axisB", "axisL"))
    if models is None:
        req = rep.select("municipalityName", "axisB", "axisL",
                         F.lit(kwp).alias("kwp"), F.lit(pv_tech).alias("pv_tech"))
    else:
        m = models.select("municipalityName", F.col("kwp").alias("_kwp"), F.col("pv_tech").alias("_tech"))
        req = rep.join(m, "municipalityName", "left").select(
            "municipalityName", "axisB", "axisL",
            F.coalesce("_kwp", F.lit(kwp)).alias("kwp"), F.coalesce("_tech", F.lit(pv_tech)).alias("pv_tech"))
    return req.withColumn("request", request_text("axisB", "axisL", "kwp", "pv_tech", endpoint))


# ---------------------------------------------------------------------------
def parse_yield_reports(replies: DataFrame, body: str = "body", keep: Sequence[str] | None = None) -> DataFrame:
    """Yearly energy / 1000 from each reply text (NULL without a 'Year' line)."""
    keep = [c for c in replies.columns if c != body] if keep is None else list(keep)
    return replies.select(*keep, yearly_energy(body).alias(yield_column(1)))


def yield_multiples(yields: DataFrame, counts: Sequence[int] = PANEL_COUNTS) -> DataFrame:
    """Add ``kwh_per_year_for_N_panel = N * kwh_per_year_for_1_panel`` for each N > 1."""
    one = F.col(yield_column(1))
    return yields.withColumns({yield_column(n): one * F.lit(n) for n in counts if n != 1})


def attach_yield(
    addresses: DataFrame,
    yields: DataFrame,
    *,
    key: str = "municipalityName",
    counts: Sequence[int] = PANEL_COUNTS,
) -> DataFrame:
    """Left-join per-municipality yields (and multiples) onto every address.

    A key with several yields counts once, with the largest (NULL last), so no
    address is repeated.  The reduced yields are one row per municipality;
    Spark broadcasts them when it knows them to be small, else the join
    shuffles and adaptive execution splits a hot municipality.
    """
    one = first_per_key(yields.select(key, yield_column(1)), [key], [F.col(yield_column(1)).desc_nulls_last()])
    return addresses.join(yield_multiples(one, counts), [key], "left")


def model_parameters(catalogue: DataFrame, model_name: str, *, case_sensitive: bool = True,
                     default_kwp: float = DEFAULT_KWP, default_tech: str = DEFAULT_PV_TECH) -> tuple[float, str]:
    """(kWp, technology code) of one requested panel model.

    The model name is normalised, matched with ``match_catalogue`` (first
    catalogue name starting with it) and the single result row is read on
    the driver; an unknown model gives the defaults.
    """
    spark = catalogue.sparkSession
    req = spark.createDataFrame([(model_name,)], "raw string").select(
        normalise_model_name(F.col("raw")).alias("request_name"))
    row = match_catalogue(req, catalogue, case_sensitive=case_sensitive,
                          default_kwp=default_kwp, default_tech=default_tech).first()
    return float(row["kwp"]), str(row["pv_tech"])
