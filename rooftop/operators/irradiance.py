"""Irradiance readings folded to hourly means, and the energy they give.

Readings carry a local wall-clock time (TIMESTAMP_NTZ) or a Unix epoch that
``local_time`` turns into one for a given zone.  Hours are keyed by the local
wall-clock hour, so the repeated autumn hour is one group (as a label-keyed
fold does); ``make_timestamp_ntz`` truncates without passing through the
session zone (``date_trunc`` on NTZ would return a zoned timestamp).

Output of ``hourly_irradiance``:

    hour (timestamp_ntz), timestamp (bigint epoch of that local hour in ``tz``),
    label ('dd/MM/yyyy, HH:mm:ss'), wats_per_meter (double mean)

The fold is one ``groupBy`` with map-side partial averages, so a busy hour
costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import READING_INTERVAL_S, hourly_energy_wh

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
HOUR_LABEL_FORMAT = "dd/MM/yyyy, HH:mm:ss"  # strftime "%d/%m/%Y, %H:%M:%S"


def local_time(epoch: str | Column, tz: str = "UTC") -> Column:
    """Unix epoch seconds (double) -> local wall-clock TIMESTAMP_NTZ in ``tz``.

    Independent of the session zone: microseconds are added to the NTZ epoch,
    then shifted from UTC to ``tz``.
    """
    e = F.col(epoch) if isinstance(epoch, str) else epoch
    micros = F.round(e.cast("double") * F.lit(1_000_000)).cast("long")
    utc = F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    if tz.upper() in ("UTC", "ETC/UTC", "Z"):
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def hour_of(ts: str | Column) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0))


def epoch_of_local(ntz: str | Column, tz: str = "UTC") -> Column:
    """Epoch seconds of a local wall-clock time in ``tz`` (like ``time.mktime``)."""
    t = F.col(ntz) if isinstance(ntz, str) else ntz
    if tz.upper() not in ("UTC", "ETC/UTC", "Z"):
        t = F.convert_timezone(F.lit(tz), F.lit("UTC"), t)
    return F.unix_timestamp(t)  # NTZ is read as UTC, whatever the session zone


def hourly_irradiance(readings: DataFrame, ts: str = "ts", value: str = "watts", tz: str = "UTC",
                      lateness: str = "1 hour") -> DataFrame:
    """Mean reading per local hour (see module doc).

    A streaming ``readings`` frame gets the streaming form (event-time
    windows with a watermark of ``lateness``, append mode); the columns are
    the same.
    """
    if readings.isStreaming:
        from ..streaming.hourly import hourly_irradiance_stream
        return hourly_irradiance_stream(readings, ts=ts, value=value, lateness=lateness, tz=tz)
    hourly = readings.groupBy(hour_of(ts).alias("hour")).agg(F.avg(value).alias("wats_per_meter"))
    return hourly.select(
        "hour",
        epoch_of_local("hour", tz).alias("timestamp"),
        F.date_format("hour", HOUR_LABEL_FORMAT).alias("label"),
        "wats_per_meter",
    )


def total_kwh(hourly: DataFrame, value: str = "wats_per_meter", interval_s: int = READING_INTERVAL_S) -> DataFrame:
    """Sum of the hourly energies in kWh (one row, column ``total_kwh``)."""
    return hourly.agg(F.sum(hourly_energy_wh(value, interval_s) / F.lit(1000)).alias("total_kwh"))
