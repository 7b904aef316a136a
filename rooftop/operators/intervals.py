"""Irregular readings: each counts for the time since the reading before it.

The logger is meant to write every 20 seconds, but it skips, repeats and starts
anew, in files that overlap.  So a mean over readings is not a mean over time.
Here a reading holds from the reading before it (over all files, in one order of
time) to its own time; an interval longer than ``max_gap_s`` is a gap that counts
for nothing, and one that crosses the end of an hour is cut there.

The order over all rows needs no task that sees them all: rows go to range
partitions of (time, tie-breaks, place), each partition takes the row before from
its own rows, and its first row takes the last row of the partition before, from
a table of one row per partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions._util import fresh_name, name_col
from ..session import materialized
from .irradiance import HOUR_LABEL_FORMAT, epoch_of_local, hour_of

DEFAULT_ROWS_PER_RANGE = 1_000_000
DEFAULT_MAX_GAP_S = 3600
_LOCAL_BITS = (1 << 33) - 1


def with_previous(df: DataFrame, order: Sequence[str], carry: Sequence[str], out: str = "previous",
                  rows_per_range: int = DEFAULT_ROWS_PER_RANGE) -> DataFrame:
    """Add ``out``: a struct of the ``carry`` columns of the row before in the order of all rows (NULL for the first).

    NULLs stand first; rows equal in ``order`` stand as in the input.  The
    result is written once to the scratch folder on the way.
    """
    part, pos, place, n, last, before = (fresh_name([*df.columns, out], c) for c in (
        "_part", "_pos", "_place", "_n", "_last", "_before"))
    by = [name_col(c).asc_nulls_first() for c in order]
    rows = df.withColumn(place, F.monotonically_increasing_id())
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / max(1, int(rows_per_range))))
    ranged = materialized(
        rows.repartitionByRange(parts, *by, place).sortWithinPartitions(*by, place)
        .select("*", F.spark_partition_id().alias(part))
        .withColumn(pos, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS))), "ranged")
    carried = F.struct(*[name_col(c) for c in carry])
    # one row per partition: its last row, handed to the next partition that has rows
    ends = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(n), F.max_by(carried, pos).alias(last))
    ends = ends.select(part, n, F.lag(last).over(Window.orderBy(part)).alias(before)).drop(n)
    own = F.lag(carried).over(Window.partitionBy(part).orderBy(pos))
    return ranged.withColumn(out, own).join(F.broadcast(ends), part) \
        .withColumn(out, F.when(F.col(pos) == 0, F.col(before)).otherwise(F.col(out))) \
        .drop(part, pos, place, before)


def time_weighted_hours(readings: DataFrame, ts: str = "ts", value: str = "watts", *, tiebreak: Sequence[str] = (),
                        max_gap_s: int = DEFAULT_MAX_GAP_S, tz: str = "UTC",
                        rows_per_range: int = DEFAULT_ROWS_PER_RANGE) -> DataFrame:
    """Per local hour: seconds covered by readings, and the mean over that time.

    Output: hour, timestamp, label (as ``hourly_irradiance``), ``covered_s``,
    ``wats_per_meter``.  An hour without covered time has no row.  Readings
    without a time or value are left out before the order is taken, so the next
    reading holds since the last complete one.
    """
    if not 0 < max_gap_s <= 3600:
        raise ValueError("max_gap_s lies in (0, 3600]: an interval meets two hours at most")
    rows = readings.select(name_col(ts).alias("ts"), name_col(value).cast("double").alias("v"),
                           *[name_col(c).alias(f"t{i}") for i, c in enumerate(tiebreak)]) \
        .filter(F.col("ts").isNotNull() & F.col("v").isNotNull())
    timed = with_previous(rows, ["ts", *[f"t{i}" for i in range(len(tiebreak))]], ["ts"], "p", rows_per_range) \
        .select("ts", "v", F.col("p.ts").alias("start"))
    micros = F.timestamp_diff("MICROSECOND", F.col("start"), F.col("ts"))
    held = timed.filter((micros > 0) & (micros <= F.lit(max_gap_s * 1_000_000)))
    end_hour = hour_of("ts")
    # the part after the last full hour belongs to that hour, what lies before to the one the interval began in
    cut = F.greatest(F.col("start"), end_hour)
    pieces = held.select("v", F.explode(F.array(
        F.struct(end_hour.alias("hour"), F.timestamp_diff("MICROSECOND", cut, F.col("ts")).alias("us")),
        F.struct(hour_of("start").alias("hour"), F.timestamp_diff("MICROSECOND", F.col("start"), cut).alias("us")))).alias("p")) \
        .select("v", "p.*").filter(F.col("us") > 0)
    hours = pieces.groupBy("hour").agg(F.sum("us").alias("us"), F.sum(F.col("v") * F.col("us")).alias("total"))
    return hours.select(
        "hour", epoch_of_local("hour", tz).alias("timestamp"), F.date_format("hour", HOUR_LABEL_FORMAT).alias("label"),
        (F.col("us") / F.lit(1e6)).alias("covered_s"), (F.col("total") / F.col("us")).alias("wats_per_meter"))
