"""Samples of an exact size in every group, without sorting a group.

A group of n rows gives round(p n / 100) rows (half up) to level p: those with
the smallest draws, so a level lies inside the next and any run draws the same.
The draw is a 60-bit hash of the row's key.  Where a group's cut lies is found
by counting: a histogram of the draws' leading 12 bits (a combinable count)
shows the bucket that the cut falls into; while such a bucket holds more rows
than one task should rank, its rows are counted by the next 12 bits.  Only the
rows of these last buckets are ranked, and only there are ties of a draw (rows
of one key) settled: by key, then by the row's values, then by its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._util import as_col, name_col
from ..session import materialized
from .adoption import ADOPTION_LEVELS, total_column
from .yields import YIELD_COLUMNS

DRAW_BITS = 60
STEP_BITS = 12
DEFAULT_RANKED_ROWS = 1_000_000


def wide_draw(key: str | Column, seed: int = 0) -> Column:
    """60 bits from the key: the first 15 hex digits of ``md5(seed ':' key)``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(as_col(key).cast("string"), F.lit("NULL"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sample_size(n: str | Column, percent: int) -> Column:
    """round(n * percent / 100), half up, in whole numbers."""
    return F.floor((as_col(n) * F.lit(2 * percent) + F.lit(100)) / F.lit(200))


def _drawn(df: DataFrame, key: str, group: str, columns: Sequence[str], seed: int) -> DataFrame:
    """Slim rows, written once: g, k, u, t (hash of the values), place, v0, v1, ..."""
    values = [name_col(c).alias(f"v{i}") for i, c in enumerate(columns)]
    return materialized(df.select(
        name_col(group).alias("g"), name_col(key).cast("string").alias("k"), wide_draw(name_col(key), seed).alias("u"),
        F.xxhash64(*[name_col(c) for c in df.columns]).alias("t"), F.monotonically_increasing_id().alias("place"),
        *values), "drawn")


def _head(u: Column, bits: int) -> Column:
    return F.shiftright(u, DRAW_BITS - bits)


def cuts(drawn: DataFrame, levels: Sequence[int], ranked_rows: int = DEFAULT_RANKED_ROWS) -> tuple[DataFrame, int]:
    """(g, level, head, rest) and the bits of ``head``: rows with smaller leading bits are in, of those
    with equal ones the first ``rest``."""
    sizes = drawn.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.select("g", F.explode(F.array(*[
        F.struct(F.lit(int(p)).alias("level"), sample_size("n", p).alias("rest")) for p in levels])).alias("w")) \
        .select("g", "w.level", "w.rest").withColumn("head", F.lit(0).cast("long"))
    bits = 0
    while True:
        nxt = min(DRAW_BITS, bits + STEP_BITS)
        rows = drawn.select("g", _head(F.col("u"), bits).alias("head"), _head(F.col("u"), nxt).alias("next"))
        if bits:  # only the buckets that a cut falls into
            some = wanted.select(F.col("g").alias("g_"), F.col("head").alias("head_")).distinct()
            rows = rows.join(some, F.col("g").eqNullSafe(F.col("g_")) & (F.col("head") == F.col("head_")), "left_semi")
        counts = rows.groupBy("g", "head", "next").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("g", "head").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.coalesce(F.sum("n").over(upto), F.lit(0))) \
            .select(F.col("g").alias("g_"), F.col("head").alias("head_"), "next", "n", "below")
        # the bucket in which the cut lies; a level that takes nothing cuts below the first one
        hit = F.col("g").eqNullSafe(F.col("g_")) & (F.col("head") == F.col("head_")) \
            & (F.greatest(F.col("rest"), F.lit(1)) > F.col("below")) & (F.greatest(F.col("rest"), F.lit(1)) <= F.col("below") + F.col("n"))
        found = materialized(wanted.join(counts, hit).select(
            "g", "level", F.col("next").alias("head"), (F.col("rest") - F.col("below")).alias("rest"), "n"), "cuts")
        bits, wanted = nxt, found.drop("n")
        most = found.agg(F.max("n")).first()[0]
        if bits == DRAW_BITS or most is None or most <= ranked_rows:
            return wanted, bits


def adoption_totals_exact(
    capacity: DataFrame,
    levels: Sequence[int] = ADOPTION_LEVELS,
    *,
    key: str = "entranceObjectId",
    group: str = "municipalityName",
    columns: Sequence[str] = YIELD_COLUMNS,
    seed: int = 0,
    ranked_rows: int = DEFAULT_RANKED_ROWS,
) -> DataFrame:
    """Totals of exactly round(p n / 100) households of every group for each level p (see module doc).

    Output: adoption, the group, households, N_panel_total_mwh...  A level that
    takes no row of a group has none.  Rows below a cut's bucket are summed by one
    combinable aggregate for all levels; the ranked ones are added to it.
    """
    for p in levels:
        if not 0 < p <= 100:
            raise ValueError(f"adoption level {p} is not a percentage in (0, 100]")
    drawn = _drawn(capacity, key, group, columns, seed)
    cut, bits = cuts(drawn, levels, ranked_rows)
    values = [f"v{i}" for i in range(len(columns))]
    of_group = cut.groupBy(F.col("g").alias("g_")).agg(*[
        F.max(F.when(F.col("level") == p, F.col("head"))).alias(f"head_{p}") for p in levels])
    placed = drawn.withColumn("head", _head(F.col("u"), bits))
    below = placed.join(of_group, F.col("g").eqNullSafe(F.col("g_")))
    sums = []
    for p in levels:
        member = F.col("head") < F.col(f"head_{p}")
        sums += [F.count(F.when(member, 1)).alias(f"n_{p}"),
                 *[F.sum(F.when(member, F.col(v))).alias(f"{v}_{p}") for v in values]]
    wide = below.groupBy("g").agg(*sums)
    below = wide.select("g", F.explode(F.array(*[
        F.struct(F.lit(int(p)).alias("level"), F.col(f"n_{p}").alias("n"), *[F.col(f"{v}_{p}").alias(v) for v in values])
        for p in levels])).alias("s")).select("g", "s.*")

    at = cut.select(F.col("g").alias("g_"), "level", F.col("head").alias("head_"), "rest")
    ranked = placed.join(at, F.col("g").eqNullSafe(F.col("g_")) & (F.col("head") == F.col("head_")))
    order = Window.partitionBy("g", "level").orderBy("u", F.col("k").asc_nulls_first(), "t", "place")
    inside = ranked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("rest")) \
        .groupBy("g", "level").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(v) for v in values])
    both = below.unionByName(inside).groupBy("g", "level").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in values])
    return both.filter(F.col("n") > 0).select(
        F.col("level").alias("adoption"), F.col("g").alias(group), F.col("n").alias("households"),
        *[F.col(v).alias(total_column(c)) for v, c in zip(values, columns)])
