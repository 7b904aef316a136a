"""Panels per roof and whole-roof yield.

Each address gets a roof area from a list, indexed by its global row number
(ordered by entrance id) modulo the list length; then

    panel_area                       = (1.755 + 1) * (1.038 + 1)
    possible_panel_count             = floor(area / panel_area)          (bigint)
    possible_kwh_per_year_whole_roof = kwh_per_year_for_1_panel * count

The row number comes from ``global_row_number`` (bucketed, no single-partition
window) and the list lookup is ``get(array literal, index)``: no Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions._util import fresh_name
from ..functions.formulas import PANEL_FOOTPRINT_M2, panels_on_roof
from .addresses import DEDUP_KEYS
from .numbering import global_row_number
from .yields import yield_column


def default_roof_areas(n: int = 22, mean: int = 140, step: int = 4) -> list[int]:
    """Deterministic area list: ``n`` values symmetric around ``mean`` (square metres).

    With the defaults: 22 values from 100 to 180, mean exactly 140, each in
    40..180 like the original random list.
    """
    half = [mean - step * j for j in range(n // 2)] + [mean + step * j for j in range(n // 2)]
    if n % 2:
        half.append(mean)
    return half


def check_roof_areas(areas: Sequence[int], lo: int = 40, hi: int = 180, mean: float | None = 140) -> list[int]:
    areas = [int(a) for a in areas]
    if not areas:
        raise ValueError("roof area list is empty")
    if any(a < lo or a > hi for a in areas):
        raise ValueError(f"roof areas must lie in [{lo}, {hi}]")
    if mean is not None and sum(areas) / len(areas) != mean:
        raise ValueError(f"roof areas must average {mean}")
    return areas


def assign_roof_area(df: DataFrame, areas: Sequence[int] | None = None, *, key: str = "entranceObjectId",
                     tiebreak: Sequence[str] = (), materialize: bool = False) -> DataFrame:
    """Replace/add ``area`` = areas[row_number(key) % len(areas)] (0-based list)."""
    areas = check_roof_areas(default_roof_areas() if areas is None else areas)
    rn = fresh_name(df.columns, "_rn")
    numbered = global_row_number(df, key, out=rn, tiebreak=tiebreak, materialize=materialize)
    arr = F.array(*[F.lit(a) for a in areas])
    return numbered.withColumn("area", F.get(arr, (F.col(rn) % F.lit(len(areas))).cast("int"))).drop(rn)


def roof_panels(capacity: DataFrame, areas: Sequence[int] | None = None, *, key: str = "entranceObjectId",
                footprint: float = PANEL_FOOTPRINT_M2, materialize: bool = False) -> DataFrame:
    """Capacity table -> roof table (area replaced, panel columns added).

    Pass ``materialize=True`` when ``capacity`` is an expensive plan rather
    than a stored table (see ``global_row_number``).
    """
    base = capacity.drop("area") if "area" in capacity.columns else capacity
    # an entrance can repeat (one row per building version): order those rows
    # by the address keys so the numbering is the same on every run
    tiebreak = [c for c in DEDUP_KEYS if c in base.columns and c != key]
    with_area = assign_roof_area(base, areas, key=key, tiebreak=tiebreak, materialize=materialize)
    count = panels_on_roof("area", footprint)
    return with_area.withColumns({
        "panel_area": F.lit(footprint),
        "possible_panel_count": count,
    }).withColumn(
        "possible_kwh_per_year_whole_roof", F.col(yield_column(1)) * F.col("possible_panel_count")
    )
