"""Streaming form of the hourly irradiance fold.

Readings arrive as a stream (any streaming source with a wall-clock
``TIMESTAMP_NTZ`` column).  Event time is that wall clock read as if it were
UTC, so one-hour tumbling windows are exactly the local clock hours, DST does
not split or merge anything beyond what the local labels already do, and the
session zone plays no part.  A watermark bounds the state: a window is emitted
once (append mode) when the watermark passes its end, and late readings beyond
``lateness`` are dropped, as Structured Streaming does.

Output columns match ``operators.irradiance.hourly_irradiance``:
``hour, timestamp, label, wats_per_meter``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.addresses import first_per_key
from ..operators.irradiance import HOUR_LABEL_FORMAT, epoch_of_local


def _epoch_ntz():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _as_utc_instant(ntz_col: str):
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch_ntz(), F.col(ntz_col)))


def _wall_clock(instant):
    return F.timestamp_add("SECOND", F.unix_seconds(instant), _epoch_ntz())


def hourly_irradiance_stream(readings: DataFrame, ts: str = "ts", value: str = "watts",
                             lateness: str = "1 hour", tz: str = "UTC", unique: Sequence[str] = ()) -> DataFrame:
    """Streaming (or batch) frame of hourly means with a watermark of ``lateness``.

    ``unique`` names the columns that tell readings apart: one delivered again
    within ``lateness`` of event time counts once (the first to arrive).  Their
    values are held as state for that long, spread by a hash of them; without
    ``unique`` nothing is held but the open hours.
    """
    events = readings.select(_as_utc_instant(ts).alias("_t"), F.col(value).alias("_v"),
                             *[F.col(c).alias(f"_k{i}") for i, c in enumerate(unique)]).withWatermark("_t", lateness)
    if unique:
        keys = [f"_k{i}" for i in range(len(unique))]
        events = events.dropDuplicatesWithinWatermark(keys) if readings.isStreaming else events.dropDuplicates(keys)
    hourly = (
        events
        .groupBy(F.window("_t", "1 hour").alias("_w"))
        .agg(F.avg("_v").alias("wats_per_meter"))
    )
    hour = _wall_clock(F.col("_w.start"))
    return hourly.select(
        hour.alias("hour"),
        epoch_of_local(hour, tz).alias("timestamp"),
        F.date_format(hour, HOUR_LABEL_FORMAT).alias("label"),
        "wats_per_meter",
    )


def run_available_now(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                      state_partitions: int | None = None) -> StreamingQuery:
    """Process everything available now into ``path`` (append), then stop.

    A stateful query keeps its state in as many partitions as
    ``spark.sql.shuffle.partitions`` says when it first starts (the number is
    then fixed in its checkpoint).  ``state_partitions`` sets that number for
    this query only: the session value is restored once the query has
    started.  The hourly state holds one row per hour (and sensor), so a
    small number suffices unless there are very many sensors.
    """
    conf = stream.sparkSession.conf
    previous = conf.get("spark.sql.shuffle.partitions")
    if state_partitions is not None:
        conf.set("spark.sql.shuffle.partitions", str(int(state_partitions)))
    try:
        q = (
            stream.writeStream.format(fmt)
            .outputMode("append")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set("spark.sql.shuffle.partitions", previous)
    q.awaitTermination()
    return q


def run_to_end(stream: DataFrame, path: str, checkpoint: str, state_partitions: int | None = None) -> DataFrame:
    """Process everything available now and return every window, the ones still open included.

    Update mode: each micro-batch writes the windows it changed under its own
    number (a batch that is run again overwrites its folder), and the latest
    value of an hour is its result.  The state is that of the append form; what
    is folded at the end is one row per hour and batch that touched it.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf = spark.conf
    previous = conf.get("spark.sql.shuffle.partitions")
    if state_partitions is not None:
        conf.set("spark.sql.shuffle.partitions", str(int(state_partitions)))
    try:
        q = (stream.writeStream.outputMode("update").foreachBatch(keep)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        conf.set("spark.sql.shuffle.partitions", previous)
    q.awaitTermination()
    changed = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    return first_per_key(changed, ["hour"], [F.col("batch").desc()]).select(*stream.columns)


def read_stream_files(spark: SparkSession, directory: str, schema: str, fmt: str = "parquet",
                      name_glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over ``directory`` (files matching ``name_glob`` when given)."""
    r = spark.readStream.format(fmt).schema(schema)
    if name_glob:
        r = r.option("pathGlobFilter", name_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(directory)
