"""Yield totals per municipality for several adoption levels (15/30/50/100 %).

Keyed form (default): a household is in level ``p`` when
``u(key) < p * 100``, with ``u`` = first 32 bits of ``md5(seed ':' key)`` mod
10000.  The draw is a pure function of the key, so it is repeatable (a lost
task recomputes the same rows) and the levels nest: 15 % lies inside 30 %,
inside 50 %, and 100 % is every row.  All levels come out of one scan and one
``groupBy(municipality)`` with a conditional sum per level (no row is
multiplied), with map-side partial sums, so a municipality holding a third of
all rows is combined per task before the shuffle.

Bernoulli form: an independent uniform draw per row and level, as the
original job's ``sample(fraction)`` per level, done in the same single pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .yields import YIELD_COLUMNS

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
ADOPTION_LEVELS: tuple[int, ...] = (15, 30, 50, 100)


def total_column(yield_col: str) -> str:
    """kwh_per_year_for_4_panel -> 4_panel_total_mwh (names as the output tables use)."""
    n = yield_col.removeprefix("kwh_per_year_for_").removesuffix("_panel")
    return f"{n}_panel_total_mwh"


def keyed_draw(key: str | Column, seed: int = 0) -> Column:
    """Uniform draw in [0, 10000) from the key: md5 based, equal in any SQL engine."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(10000)


def _sums(columns: Sequence[str]) -> list[Column]:
    return [F.sum(c).alias(total_column(c)) for c in columns]


def adoption_totals(
    capacity: DataFrame,
    levels: Sequence[int] = ADOPTION_LEVELS,
    *,
    key: str = "entranceObjectId",
    group: str = "municipalityName",
    columns: Sequence[str] = YIELD_COLUMNS,
    seed: int = 0,
) -> DataFrame:
    """Keyed, nested samples; one pass.  Output: adoption, group, N_panel_total_mwh...

    One ``groupBy(group)`` holds, for every level, a member count and the
    sums of the members (``sum(when(u < p * 100, col))``), so rows are not
    multiplied by the number of levels; the small aggregate is then stacked
    to one row per (level, group).  A level without members in a group has
    no row, as a sampled ``groupBy`` would give.
    """
    for p in levels:
        if not 0 < p <= 100:
            raise ValueError(f"adoption level {p} is not a percentage in (0, 100]")
    drawn = capacity.select(group, *columns, keyed_draw(key, seed).alias("_u"))
    aggs = []
    for p in levels:
        member = F.col("_u") < F.lit(int(p) * 100)
        aggs.append(F.count(F.when(member, F.lit(1))).alias(f"_n_{p}"))
        aggs += [F.sum(F.when(member, F.col(c))).alias(f"_{p}_{c}") for c in columns]
    return _stack_levels(drawn.groupBy(group).agg(*aggs), levels, group, columns)


def _stack_levels(wide: DataFrame, levels: Sequence[int], group: str, columns: Sequence[str]) -> DataFrame:
    """One row per (level, group) from the per-level columns of a small aggregate."""
    stacked = wide.select(group, F.explode(F.array(*[
        F.struct(F.lit(int(p)).alias("adoption"), F.col(f"_n_{p}").alias("_n"),
                 *[F.col(f"_{p}_{c}").alias(total_column(c)) for c in columns])
        for p in levels])).alias("_l"))
    return stacked.filter(F.col("_l._n") > 0).select(
        F.col("_l.adoption").alias("adoption"), group, *[F.col(f"_l.{total_column(c)}") for c in columns])


def adoption_totals_bernoulli(
    capacity: DataFrame,
    levels: Sequence[int] = ADOPTION_LEVELS,
    *,
    key: str = "entranceObjectId",
    group: str = "municipalityName",
    columns: Sequence[str] = YIELD_COLUMNS,
    seed: int = 0,
) -> DataFrame:
    """Independent Bernoulli draw per level, as the original job's ``sample(p)`` calls.

    One pass instead of one scan per level: each row gets one draw per level
    from its key (``keyed_draw`` with seed + i for the i-th level, so the levels
    are independent, not nested), and one aggregate holds the conditional sums of
    every level, as in ``adoption_totals``.  The draws do not depend on the
    partitioning, so the result repeats exactly.
    """
    for p in levels:
        if not 0 < p <= 100:
            raise ValueError(f"adoption level {p} is not a percentage in (0, 100]")
    drawn = capacity.select(group, *columns, *[keyed_draw(key, seed + i).alias(f"_u{i}") for i in range(len(levels))])
    aggs = []
    for i, p in enumerate(levels):
        member = F.col(f"_u{i}") < F.lit(int(p) * 100)
        aggs.append(F.count(F.when(member, F.lit(1))).alias(f"_n_{p}"))
        aggs += [F.sum(F.when(member, F.col(c))).alias(f"_{p}_{c}") for c in columns]
    return _stack_levels(drawn.groupBy(group).agg(*aggs), levels, group, columns)


def split_by_level(totals: DataFrame, levels: Sequence[int] = ADOPTION_LEVELS) -> dict[int, DataFrame]:
    """One frame per level (for writing each level to its own table)."""
    return {p: totals.filter(F.col("adoption") == p).drop("adoption") for p in levels}


def level_outputs(totals: DataFrame, names: Mapping[int, str], materialize: bool = True) -> dict[str, DataFrame]:
    """Output frames of a job that writes each level to its own table, by output name.

    Each level is a filter of ``totals``; with ``materialize`` the totals (one
    row per level and municipality) are first written to the scratch folder, so
    the capacity table is scanned once for all levels.
    """
    if materialize:
        from ..session import materialized
        totals = materialized(totals, "level-totals")
    parts = split_by_level(totals, list(names))
    return {names[p]: parts[p] for p in names}
