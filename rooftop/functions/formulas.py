"""Numeric formulas as column expressions.

Operand order follows the reference's arithmetic so that doubles come out bit
for bit the same (for example household saving 252.49999999999994 for a
production of 3179 kWh and full adoption).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# Panel technology name -> code of the yield service; unknown -> "crystSi".
PV_TECH_CODES: dict[str, str] = {
    "Mono-c-Si": "crystSi",
    "Multi-c-Si": "crystSi",
    "Standardny (PV)": "crystSi",
    "Thin Film": "Unknown",
    "CdTe": "CdTe",
    "CIGS": "CIS",
}
DEFAULT_PV_TECH = "crystSi"
# Peak power (kWp) used when a model is not in the catalogue.
DEFAULT_KWP = 0.346
# Catalogue STC watts -> kWp.
STC_TO_KWP = 1000.0
# Yield multiples per panel count.
PANEL_COUNTS: tuple[int, ...] = (1, 4, 8, 10, 12)
# Module size in metres; the roof footprint per panel adds one metre each way.
MODULE_LENGTH_M = 1.755
MODULE_WIDTH_M = 1.038
PANEL_FOOTPRINT_M2 = (MODULE_LENGTH_M + 1) * (MODULE_WIDTH_M + 1)
# Irradiance to energy.
MODULE_AREA_M2 = MODULE_LENGTH_M * MODULE_WIDTH_M
MODULE_EFFICIENCY = 0.19
MODULE_COUNT = 8
SECONDS_IN_HOUR = 3600
READING_INTERVAL_S = 20
# Query text of a yield request.
REQUEST_TEMPLATE = (
    "outputformat=basic&lat={lat}&lon={lon}&raddatabase=PVGIS-SARAH2&browser=0&peakpower={kwp}&loss=14"
    "&mountingplace=building&pvtechchoice={pv_tech}&optimalinclination=1&aspect=0&usehorizon=1&userhorizon=&js=1"
)


def tech_code(technology: str | Column) -> Column:
    """Technology name to service code through a literal map; unknown -> crystSi."""
    pairs = []
    for name, code in PV_TECH_CODES.items():
        pairs += [F.lit(name), F.lit(code)]
    return F.coalesce(F.create_map(*pairs)[as_col(technology)], F.lit(DEFAULT_PV_TECH))


def kwp_from_stc(stc: str | Column) -> Column:
    return as_col(stc) / F.lit(STC_TO_KWP)


def panels_on_roof(area: str | Column, footprint: float = PANEL_FOOTPRINT_M2) -> Column:
    """floor(area / footprint) as bigint."""
    return F.floor(as_col(area).cast("double") / F.lit(footprint))


def hourly_energy_wh(watts_per_m2: str | Column, interval_s: int = READING_INTERVAL_S,
                     efficiency: float = MODULE_EFFICIENCY, area_m2: float = MODULE_AREA_M2,
                     modules: int = MODULE_COUNT) -> Column:
    """Mean irradiance of an hour -> Wh from the modules (reference operand order)."""
    w = as_col(watts_per_m2)
    return w * F.lit(SECONDS_IN_HOUR) / F.lit(interval_s) * F.lit(efficiency) * F.lit(area_m2) * F.lit(modules)


# ---------------------------------------------------------------------------
# CO2 savings
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Scenario:
    """One parameter set of the CO2 calculator.

    Defaults are the reference's constants (fixed values).  ``adoption`` is the
    share of households with panels, ``solar_coverage`` the share of electric
    driving charged from the panels.
    """

    name: str
    adoption: float
    solar_coverage: float = 0.5
    household_ykwh_average: float = 2500.0
    households: float = 1.0
    km_driven: float = 0.0
    cars_per_household: float = 2.0
    diesel_cars: float = 1.0
    zse_co2: float = 0.142
    solar_co2: float = 0.041
    electric_km: float = 0.195
    diesel_co2: float = 0.208

    def as_struct(self) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in asdict(self).items()])


def _car_km(s: Column) -> Column:
    car_count = s["households"] * s["cars_per_household"] * s["diesel_cars"] * s["adoption"]
    return car_count * s["km_driven"]


def diesel_co2(s: Column) -> Column:
    return _car_km(s) * s["diesel_co2"]


def electric_solar_co2(s: Column, coverage: Column) -> Column:
    return _car_km(s) * s["solar_co2"] * s["electric_km"] * coverage


def electric_grid_co2(s: Column, coverage: Column) -> Column:
    return _car_km(s) * s["zse_co2"] * s["electric_km"] * coverage


def car_co2_savings(s: Column) -> Column:
    """Diesel minus electric (solar share + grid share) emissions per household."""
    c = s["solar_coverage"]
    return diesel_co2(s) - electric_solar_co2(s, c) - electric_grid_co2(s, F.lit(1.0) - c)


def household_co2_savings(s: Column, production_kwh: str | Column) -> Column:
    """Grid CO2 avoided by a household producing ``production_kwh`` a year."""
    p = as_col(production_kwh)
    avg = s["household_ykwh_average"]
    coverage = F.when(p > avg, F.lit(1.0)).otherwise(p / avg)
    return s["households"] * avg * coverage * (s["zse_co2"] - s["solar_co2"]) * s["adoption"]
