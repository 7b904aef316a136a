"""Stamped builds and appends that count once.

``StampedTable``: every write is a build with a time stamp, a partition column
of the table (``TableOut(build_datetime=True)``).  A build may bring only some
values of the other partition columns.  When its data is in place, the values it
brought are logged.  ``read`` gives, for each value, the newest logged build up
to a time; a build that was never logged (a job that failed, or one still
running) is not seen.  The builds to read become a filter on partition columns,
so Spark lists the folders and opens the files of those builds alone.

``AppendOnceTable``: every append has a job id.  A job that runs again adds
nothing, and what a failed attempt left behind is never read: each attempt
writes to a partition of its own, and the log names the attempt that counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import name_col
from .commits import CommitLog
from .deliveries import MAX_SCHEMAS
from .schemas import wider_schema
from .tables import BUILD_STAMP_COLUMN, Format, SaveMode, TableOut

# Up to so many (partition value, build) pairs a read filters by literals; beyond, by a join with the log.
MAX_LITERALS = 2_000
STAMP_FORMAT = "%Y-%m-%d %H:%M:%S"


def logged_schema(spark: SparkSession, log: CommitLog, path: str) -> T.StructType:
    """The union of the schemas that the log's entries have (columns a file lacks are read as NULL)."""
    found = log.entries(spark).select("schema").distinct().limit(MAX_SCHEMAS + 1).collect()
    if not found:
        raise ValueError(f"{path} has nothing complete to read a schema from")
    if len(found) > MAX_SCHEMAS:
        raise ValueError(f"{path} has over {MAX_SCHEMAS} schemas")
    return wider_schema(T.StructType.fromJson(json.loads(r["schema"])) for r in sorted(found))


class StampedTable:
    """A table of builds under ``path``, partitioned by ``keys`` and the build stamp."""

    def __init__(self, path: str, keys: Sequence[str] | str = (), fmt: Format = Format.PARQUET, options: dict | None = None):
        self.path, self.format, self.options = path.rstrip("/"), Format(fmt), dict(options or {})
        self.keys = (keys,) if isinstance(keys, str) else tuple(keys)
        self.log = CommitLog(self.path, "values array<string>, schema string")

    def write(self, df: DataFrame, now: datetime | None = None) -> str:
        """Write ``df`` as the build stamped ``now`` (local time, to the second) and log it; returns the stamp."""
        spark = df.sparkSession
        now = (now or datetime.now()).replace(microsecond=0)
        stamp = now.strftime(STAMP_FORMAT)
        if self.log.has(spark, stamp):
            raise ValueError(f"{self.path} has a build of {stamp}")
        self.write_data(df, now)
        # the partitions of this build: only their folders and footers are read
        mine = self._scan(spark, df.schema).filter(F.col(BUILD_STAMP_COLUMN) == F.lit(stamp).cast("timestamp"))
        brought = mine.select(*[name_col(k).cast("string").alias(k) for k in self.keys]).distinct().collect() \
            if self.keys else [()]
        if not self.log.add(spark, stamp, {"values": sorted(json.dumps(list(r)) for r in brought), "schema": df.schema.json()}):
            raise ValueError(f"{self.path} has a build of {stamp}")
        return stamp

    def write_data(self, df: DataFrame, now: datetime) -> None:
        """The data of a build without its log entry (what a job that fails halfway leaves)."""
        TableOut(self.path, format=self.format, mode=SaveMode.APPEND, partition_by=self.keys, build_datetime=True,
                 options=self.options, gather_partitions=True).write(df, now)

    def _scan(self, spark: SparkSession, schema) -> DataFrame:
        whole = T.StructType([*[f for f in schema.fields if f.name != BUILD_STAMP_COLUMN],
                              T.StructField(BUILD_STAMP_COLUMN, T.TimestampType())])
        out = TableOut(self.path, format=self.format, options=self.options)
        return out.as_input(schema=whole).read(spark) if self.format is not Format.PARQUET else \
            spark.read.schema(whole).parquet(self.path)

    def builds(self, spark: SparkSession) -> DataFrame:
        """stamp, values (JSON list of the partition values it brought) of every complete build."""
        return self.log.entries(spark).select(F.col("id").alias("stamp"), F.explode("values").alias("values"))

    def current(self, spark: SparkSession, as_of: datetime | None = None) -> DataFrame:
        """values, stamp: the newest complete build of each value up to ``as_of`` (default: the newest of all)."""
        builds = self.builds(spark)
        if as_of is not None:
            builds = builds.filter(F.col("stamp") <= as_of.strftime(STAMP_FORMAT))
        return builds.groupBy("values").agg(F.max("stamp").alias("stamp"))

    def read(self, spark: SparkSession, schema: T.StructType | None = None, as_of: datetime | None = None) -> DataFrame:
        """The rows valid at ``as_of``, with the stamp of their build.

        ``schema``: that of the data, by default what all builds can be read by (``logged_schema``).
        """
        schema = logged_schema(spark, self.log, self.path) if schema is None else schema
        table = self._scan(spark, schema)
        newest = self.current(spark, as_of)
        rows = newest.limit(MAX_LITERALS + 1).collect()
        if len(rows) <= MAX_LITERALS:
            return table.filter(self._chosen(table, [(r["stamp"], json.loads(r["values"])) for r in rows]))
        parsed = newest.select(F.to_timestamp("stamp").alias("_stamp"), F.from_json("values", "array<string>").alias("_v"))
        same = F.col("_stamp") == F.col(BUILD_STAMP_COLUMN)
        for i, k in enumerate(self.keys):
            same = same & name_col(k).cast("string").eqNullSafe(F.get("_v", F.lit(i)))
        return table.join(parsed, same, "left_semi")

    def at(self, as_of: datetime | None) -> "TableAsOf":
        """This table at a time, as an input of a job."""
        return TableAsOf(self, as_of)

    def _chosen(self, table: DataFrame, pairs: list[tuple[str, list]]) -> Column:
        """A filter on partition columns: for each build the values that it holds the newest rows of."""
        types = {f.name: f.dataType for f in table.schema.fields}
        by_stamp: dict[str, list] = {}
        for stamp, values in pairs:
            by_stamp.setdefault(stamp, []).append(values)

        def held(values: list[list]) -> Column:
            if not self.keys:
                return F.lit(True)
            if len(self.keys) == 1:
                key, given = name_col(self.keys[0]), [v[0] for v in values if v[0] is not None]
                one = key.isin([F.lit(v).cast(types[self.keys[0]]) for v in given]) if given else F.lit(False)
                return one | key.isNull() if len(given) < len(values) else one
            return reduce(or_, [reduce(lambda a, b: a & b, [
                name_col(k).eqNullSafe(F.lit(v).cast(types[k])) for k, v in zip(self.keys, row)]) for row in values])

        stamp_col = F.col(BUILD_STAMP_COLUMN)
        parts = [(stamp_col == F.lit(s).cast("timestamp")) & held(v) for s, v in sorted(by_stamp.items())]
        return reduce(or_, parts) if parts else F.lit(False)


@dataclass(frozen=True)
class TableAsOf:
    """A stamped table at a time, in the place of a ``TableIn``."""

    table: StampedTable
    as_of: datetime | None = None

    @property
    def path(self) -> str:
        return self.table.path

    def read(self, spark: SparkSession) -> DataFrame:
        return self.table.read(spark, as_of=self.as_of).drop(BUILD_STAMP_COLUMN)


class AppendOnceTable:
    """A table under ``path`` to which every job id adds rows once."""

    ATTEMPT = "attempt"

    def __init__(self, path: str, fmt: Format = Format.PARQUET, options: dict | None = None):
        self.path, self.format, self.options = path.rstrip("/"), Format(fmt), dict(options or {})
        self.log = CommitLog(self.path, "attempt string, schema string")

    def append(self, df: DataFrame, job: str) -> bool:
        """Add the rows of ``job``; False, and nothing added, if it was done before.

        Of two attempts that run at once, the first to be logged counts.
        """
        spark = df.sparkSession
        if self.log.has(spark, job):
            return False
        attempt = "a" + uuid.uuid4().hex  # never taken for a number by partition discovery
        self.write_data(df, attempt)
        return self.log.add(spark, job, {"attempt": attempt, "schema": df.schema.json()})

    def write_data(self, df: DataFrame, attempt: str) -> None:
        """The rows of an attempt, not yet logged."""
        TableOut(f"{self.path}/{self.ATTEMPT}={attempt}", format=self.format, mode=SaveMode.ERROR, build_datetime=False,
                 options=self.options).write(df)

    def output(self, job: str) -> "AppendOnce":
        """The rows of ``job`` as an output of a job."""
        return AppendOnce(self, job)

    def jobs(self, spark: SparkSession) -> DataFrame:
        """id and attempt of every job that is done."""
        return self.log.entries(spark).select("id", "attempt")

    def read(self, spark: SparkSession, schema: T.StructType | None = None) -> DataFrame:
        """The rows of all jobs that are done (``schema`` as for ``StampedTable.read``)."""
        schema = logged_schema(spark, self.log, self.path) if schema is None else schema
        done = self.jobs(spark).select("attempt")
        some = [r[0] for r in done.limit(MAX_LITERALS + 1).collect()]
        if not some:
            return spark.createDataFrame([], schema)
        read = spark.read.format(str(self.format)).schema(schema).options(**self.options).option("basePath", self.path)
        if self.format is Format.CSV:
            read = read.option("header", True)
        if len(some) <= MAX_LITERALS:
            return read.load([f"{self.path}/{self.ATTEMPT}={a}" for a in some]).drop(self.ATTEMPT)
        named = T.StructType([*schema.fields, T.StructField(self.ATTEMPT, T.StringType())])
        return read.schema(named).load(self.path).join(done, self.ATTEMPT, "left_semi").drop(self.ATTEMPT)


@dataclass(frozen=True)
class AppendOnce:
    """One job's rows for an append-once table, in the place of a ``TableOut``."""

    table: AppendOnceTable
    job: str

    @property
    def path(self) -> str:
        return self.table.path

    def write(self, df: DataFrame) -> None:
        self.table.append(df, self.job)
