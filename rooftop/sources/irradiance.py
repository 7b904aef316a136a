"""Irradiance logger files.

Raw file: a header line, then ``epoch,watts`` per reading.  Processed files:
``timestamp,wats_per_meter`` per hour, once keyed by the hour's epoch and once
by its label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.irradiance import hourly_irradiance, local_time, total_kwh
from ..session import materialized
from .tables import Format, SaveMode, TableIn, TableOut

RAW_SCHEMA = "epoch double, watts int"
HOURLY_SCHEMA = "timestamp bigint, wats_per_meter double"
LABELLED_SCHEMA = "timestamp string, wats_per_meter double"


def read_raw_readings(spark: SparkSession, path: str, tz: str = "UTC", schema: str = RAW_SCHEMA) -> DataFrame:
    """Raw CSV -> (ts local wall clock, watts).

    The header line is skipped, whatever it says.  A reading that is not of the
    schema's types stops the job, as it did in the original one.
    """
    raw = TableIn(path, format=Format.CSV, schema=schema, enforce_schema=True, options={"mode": "FAILFAST"}).read(spark)
    return raw.select(local_time("epoch", tz).alias("ts"), F.col("watts"))


def write_hourly_files(hourly: DataFrame, epoch_path: str, label_path: str,
                       mode: SaveMode = SaveMode.OVERWRITE, materialize: bool = True) -> None:
    """Write the two processed files from one hourly frame (header ``timestamp,wats_per_meter``).

    With ``materialize`` the hourly frame (one row per hour) is first written
    to the scratch folder, so the readings are scanned and folded once for both
    files.
    """
    if materialize:
        hourly = materialized(hourly, "hourly")
    out = dict(format=Format.CSV, mode=mode, build_datetime=False)
    TableOut(epoch_path, **out).write(hourly.select("timestamp", "wats_per_meter"))
    TableOut(label_path, **out).write(hourly.select(F.col("label").alias("timestamp"), "wats_per_meter"))


def read_hourly_file(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    return TableIn(path, format=Format.CSV, schema=LABELLED_SCHEMA if labelled else HOURLY_SCHEMA).read(spark)


def process_raw_file(spark: SparkSession, raw_path: str, epoch_path: str, label_path: str,
                     tz: str = "UTC") -> DataFrame:
    """Raw file -> two hourly files -> total kWh read back from the epoch-keyed file."""
    hourly = hourly_irradiance(read_raw_readings(spark, raw_path, tz), ts="ts", value="watts", tz=tz)
    write_hourly_files(hourly, epoch_path, label_path)
    return total_kwh(read_hourly_file(spark, epoch_path))
