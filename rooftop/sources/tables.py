"""Table declarations: where a DataFrame comes from and where it goes.

``TableIn`` / ``TableOut`` are frozen records of path, format and options that
resolve to ``spark.read`` / ``df.write`` calls.  Nothing is read or written
when a record is made; credentials are never defaults (pass them as options).

Formats: CSV, JSON, Parquet (default), JDBC, Delta (when the Delta data
source is on the class path).  Save modes: overwrite, append (default),
ignore, error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


class Format(str, Enum):
    CSV = "csv"
    PARQUET = "parquet"
    JSON = "json"
    JDBC = "jdbc"
    DELTA = "delta"

    def __str__(self) -> str:
        return self.value


class SaveMode(str, Enum):
    OVERWRITE = "overwrite"
    APPEND = "append"
    IGNORE = "ignore"
    ERROR = "error"

    def __str__(self) -> str:
        return self.value


BUILD_STAMP_COLUMN = "build_datetime"
# CSV and JSON keep TIMESTAMP_NTZ to the microsecond with this pattern (their
# default pattern stops at milliseconds).
NTZ_MICROS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@dataclass(frozen=True)
class TableIn:
    """A table to read.

    ``columns`` projects right after the read (Catalyst prunes the scan).  For
    CSV, ``schema`` (a ``StructType`` or DDL string) must name the file's header
    columns in their order, or the read fails (``enforce_schema`` applies it by
    position instead, for files whose header says something else); without one the schema is inferred when ``infer_schema``, which
    reads the input once more (``infer_sampling_ratio`` reads a fraction; it
    applies to JSON inference too).
    Parquet ``merge_schema`` reads every footer, so it is off unless asked for
    (Delta keeps its schema in the log; there it only allows a merge).  For
    JDBC, ``path`` is the table name and ``url`` the connection; give
    ``partition_column``/bounds/``num_partitions`` for a parallel read.
    """

    path: str
    format: Format = Format.PARQUET
    columns: tuple[str, ...] = ("*",)
    schema: T.StructType | str | None = None
    merge_schema: bool = False
    header: bool = True
    sep: str = ","
    encoding: str = "utf-8"
    enforce_schema: bool = False
    infer_schema: bool = True
    infer_sampling_ratio: float | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    url: str | None = None
    partition_column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None

    def reader(self, spark: SparkSession):
        r = spark.read
        fmt = Format(self.format)
        if fmt is Format.CSV:
            r = r.format("csv").option("header", self.header).option("sep", self.sep).option("encoding", self.encoding)
            if self.schema is not None:
                r = r.schema(self.schema).option("enforceSchema", self.enforce_schema)
            else:
                r = r.option("inferSchema", self.infer_schema)
                if self.infer_schema and self.infer_sampling_ratio is not None:
                    r = r.option("samplingRatio", self.infer_sampling_ratio)
        elif fmt is Format.JSON:
            r = r.format("json")
            if self.schema is not None:
                r = r.schema(self.schema)
            elif self.infer_sampling_ratio is not None:
                r = r.option("samplingRatio", self.infer_sampling_ratio)
        elif fmt is Format.PARQUET:
            r = r.format("parquet").option("mergeSchema", self.merge_schema)
        elif fmt is Format.DELTA:
            r = r.format("delta").option("mergeSchema", self.merge_schema)
        elif fmt is Format.JDBC:
            if not self.url:
                raise ValueError("a JDBC table needs url=")
            r = r.format("jdbc").option("url", self.url).option("dbtable", self.path)
            if self.partition_column:
                if None in (self.lower_bound, self.upper_bound, self.num_partitions):
                    raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
                r = (r.option("partitionColumn", self.partition_column)
                     .option("lowerBound", self.lower_bound)
                     .option("upperBound", self.upper_bound)
                     .option("numPartitions", self.num_partitions))
        else:  # pragma: no cover - enum is closed
            raise ValueError(f"unsupported format {self.format}")
        for k, v in self.options.items():
            r = r.option(k, v)
        return r

    def read(self, spark: SparkSession) -> DataFrame:
        fmt = Format(self.format)
        df = self.reader(spark).load() if fmt is Format.JDBC else self.reader(spark).load(self.path)
        if tuple(self.columns) != ("*",):
            df = df.select(*self.columns)
        return df

    def read_or_empty(self, spark: SparkSession, schema: T.StructType | str) -> DataFrame:
        """Read; when the path does not exist yet, an empty frame of ``schema``."""
        try:
            return self.read(spark)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return spark.createDataFrame([], schema)
            raise


def stamp_partition_keys(keys: str | Sequence[str] | None, add: str = BUILD_STAMP_COLUMN) -> list[str]:
    """Partition keys with ``add`` appended; order kept, duplicates removed."""
    if keys is None:
        base: list[str] = []
    elif isinstance(keys, str):
        base = [keys]
    else:
        base = list(keys)
    out: list[str] = []
    for k in [*base, add]:
        if k not in out:
            out.append(k)
    return out


@dataclass(frozen=True)
class TableOut:
    """A table to write.

    ``build_datetime`` adds a literal second-precision timestamp of the write
    (local time of the driver) and makes it a partition key.  ``partition_by``
    is honoured for every file format; ``gather_partitions`` first shuffles the
    rows by it, for many tasks and few values (else each task writes a file per
    value it holds).  ``overwrite_schema`` (Delta) defaults
    to True exactly when the mode is overwrite.
    """

    path: str
    format: Format = Format.PARQUET
    mode: SaveMode = SaveMode.APPEND
    partition_by: tuple[str, ...] | str | None = None
    build_datetime: bool = True
    header: bool = True
    sep: str = ","
    options: Mapping[str, str] = field(default_factory=dict)
    overwrite_schema: bool | None = None
    gather_partitions: bool = False
    url: str | None = None

    def stamped(self, df: DataFrame, now: datetime | None = None) -> tuple[DataFrame, list[str]]:
        keys = self.partition_by
        parts = [keys] if isinstance(keys, str) else list(keys or [])
        if not self.build_datetime:
            return df, parts
        ts = (now or datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
        return df.withColumn(BUILD_STAMP_COLUMN, F.lit(ts).cast("timestamp")), stamp_partition_keys(keys)

    def write(self, df: DataFrame, now: datetime | None = None) -> None:
        df, parts = self.stamped(df, now)
        fmt = Format(self.format)
        w = df.write.mode(str(SaveMode(self.mode)))
        if fmt is Format.JDBC:
            if not self.url:
                raise ValueError("a JDBC table needs url=")
            w = w.format("jdbc").option("url", self.url).option("dbtable", self.path)
            for k, v in self.options.items():
                w = w.option(k, v)
            w.save()
            return
        if parts:
            # one task per partition value and slice of it, not every task in every folder
            df = df.repartition(*parts) if self.gather_partitions else df
            w = df.write.mode(str(SaveMode(self.mode))).partitionBy(*parts)
        if fmt is Format.CSV:
            w = w.format("csv").option("header", self.header).option("sep", self.sep)
        elif fmt is Format.JSON:
            w = w.format("json")
        elif fmt is Format.PARQUET:
            w = w.format("parquet")
        elif fmt is Format.DELTA:
            ow = self.overwrite_schema if self.overwrite_schema is not None else SaveMode(self.mode) is SaveMode.OVERWRITE
            w = w.format("delta").option("overwriteSchema", ow)
        for k, v in self.options.items():
            w = w.option(k, v)
        w.save(self.path)

    def as_input(self, **kw) -> TableIn:
        """The same table as an input (same path, format and options)."""
        base = dict(path=self.path, format=self.format, options=dict(self.options), url=self.url,
                    header=self.header, sep=self.sep)
        base.update(kw)
        return TableIn(**base)

    def read_back(self, spark: SparkSession, schema: T.StructType | str | None = None, **kw) -> DataFrame:
        """Read what was written (with ``schema`` for CSV/JSON); empty frame of
        ``schema`` when nothing is there yet."""
        if schema is None:
            return self.as_input(**kw).read(spark)
        return self.as_input(schema=schema, **kw).read_or_empty(spark, schema)
