"""Raw register to clean table: sentinels, timestamps, damaged text.

The three registers (municipalities, entrances, buildings) arrive as text
exports where a missing value is the word ``None``.  Cleaning is a projection
(no shuffle): timestamp columns are parsed with NULL for the sentinel and for
unparseable text, listed text columns get the sentinel turned to NULL, and
damaged letters are repaired.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_REPAIRS, NONE_SENTINEL, nullif_sentinel, parse_timestamp, repair_text

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
MUNICIPALITY_TIMESTAMPS: tuple[str, ...] = ("validTo", "validFrom", "changedAt")
ENTRANCE_TIMESTAMPS: tuple[str, ...] = ("validTo", "validFrom", "verifiedAt", "changedAt")
BUILDING_TIMESTAMPS: tuple[str, ...] = ("changedAt", "validFrom", "validTo")
BUILDING_REPAIRS: Mapping[str, tuple[tuple[str, str], ...]] = {"buildingPurposeName": DEFAULT_REPAIRS}


# Declared types of the registers' id columns; every other raw column is text
# (a postal code keeps its leading zeros).
REGISTER_IDS: Mapping[str, tuple[str, ...]] = {
    "municipalities": ("objectId",),
    "entrances": ("objectId", "propertyRegistrationNumberIdentifier"),
    "buildings": ("objectId", "propertyRegistrationNumber", "municipalityIdentifier"),
}


def typed_register(df: DataFrame, register: str) -> DataFrame:
    """A raw text register with its id columns, by name, as bigint (NULL for a text that is none)."""
    ids = [c for c in REGISTER_IDS[register] if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in ids})


def clean_register(
    df: DataFrame,
    timestamps: Sequence[str] = (),
    *,
    sentinel_text: Sequence[str] = (),
    repairs: Mapping[str, Iterable[tuple[str, str]]] | None = None,
    sentinel: str = NONE_SENTINEL,
    fmt: str | None = None,
    ntz: bool = True,
) -> DataFrame:
    """Parse ``timestamps``, NULL the sentinel in ``sentinel_text``, apply ``repairs``.

    Columns not listed pass through unchanged and keep their position.
    """
    changes = {}
    for c in repairs or {}:
        changes[c] = repair_text(c, (repairs or {})[c])
    for c in sentinel_text:
        changes[c] = nullif_sentinel(changes.get(c, c), sentinel)
    for c in timestamps:
        changes[c] = parse_timestamp(c, sentinel, fmt, ntz)
    missing = [c for c in changes if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the register: {missing}")
    return df.withColumns(changes)


def clean_municipalities(df: DataFrame, **kw) -> DataFrame:
    return clean_register(df, MUNICIPALITY_TIMESTAMPS, **kw)


def clean_entrances(df: DataFrame, **kw) -> DataFrame:
    return clean_register(df, ENTRANCE_TIMESTAMPS, **kw)


def clean_buildings(df: DataFrame, **kw) -> DataFrame:
    kw.setdefault("repairs", BUILDING_REPAIRS)
    return clean_register(df, BUILDING_TIMESTAMPS, **kw)
