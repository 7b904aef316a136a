from .formulas import (  # noqa: F401
    DEFAULT_KWP,
    DEFAULT_PV_TECH,
    PANEL_COUNTS,
    PANEL_FOOTPRINT_M2,
    PV_TECH_CODES,
    Scenario,
    car_co2_savings,
    household_co2_savings,
    hourly_energy_wh,
    kwp_from_stc,
    panels_on_roof,
    tech_code,
)
from .text import (  # noqa: F401
    NONE_SENTINEL,
    contains_ci,
    misdecoded_pairs,
    normalise_model_name,
    nullif_sentinel,
    parse_timestamp,
    repair_text,
    yearly_energy,
)
