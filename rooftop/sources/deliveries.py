"""Many deliveries of one table, whose columns and types changed over time, read as one.

Every delivery is a folder of its own and has an entry in the table's log with
its schema.  A read takes the distinct schemas from the log, not from the files:
their union, with widened types, is the table's schema; the deliveries of one
schema are one scan (so there are as many scans as schemas, whatever the number
of deliveries), fitted to the union.  Filters and the choice of columns reach
each scan; columns that a delivery lacks are NULL.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import CommitLog
from .schemas import fitted_to, wider_schema
from .tables import Format, SaveMode, TableIn, TableOut

# Schemas of one table that a read accepts; each is a scan of its own.
MAX_SCHEMAS = 200


class Deliveries:
    """The deliveries of one table under ``path``."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.log = CommitLog(self.path, "folder string, format string, schema string, options string, delivered bigint")

    def deliver(self, df: DataFrame, name: str, fmt: Format = Format.PARQUET, options: Mapping[str, str] | None = None) -> bool:
        """Write ``df`` as the delivery ``name``; False, and nothing added, if it was delivered before.

        ``options`` go to the writer and to every reader.
        """
        spark = df.sparkSession
        if self.log.has(spark, name):
            return False
        out = TableOut(f"{self.path}/{_folder(name)}", format=fmt, mode=SaveMode.ERROR, build_datetime=False,
                       options=dict(options or {}))
        out.write(df)
        return self._enter(spark, name, out.as_input(), df.schema)

    def adopt(self, spark: SparkSession, name: str, source: TableIn) -> bool:
        """Log a delivery that someone else wrote (a file format); its schema is read once, here."""
        if self.log.has(spark, name):
            return False
        return self._enter(spark, name, source, source.read(spark).schema)

    def _enter(self, spark: SparkSession, name: str, source: TableIn, schema: T.StructType) -> bool:
        options = dict(source.options)
        if Format(source.format) is Format.CSV:
            options |= {"header": str(source.header).lower(), "sep": source.sep, "encoding": source.encoding}
        return self.log.add(spark, name, {
            "folder": source.path, "format": str(Format(source.format)), "schema": schema.json(),
            "options": json.dumps(options, sort_keys=True), "delivered": self.log.entries(spark).count()})

    def _kinds(self, spark: SparkSession) -> list:
        """Rows of (format, schema, options): each distinct one, oldest first."""
        rows = self.log.entries(spark).groupBy("format", "schema", "options").agg(F.min("delivered").alias("first")) \
            .orderBy("first", "format", "schema", "options").limit(MAX_SCHEMAS + 1).collect()
        if len(rows) > MAX_SCHEMAS:
            raise ValueError(f"{self.path} has over {MAX_SCHEMAS} schemas; rewrite old deliveries")
        return rows

    def schema(self, spark: SparkSession) -> T.StructType:
        """The union of the deliveries' schemas."""
        return wider_schema(T.StructType.fromJson(json.loads(k["schema"])) for k in self._kinds(spark))

    def read(self, spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
        """All deliveries, or those named, as one table with the schema of all."""
        kinds = self._kinds(spark)
        if not kinds:
            raise ValueError(f"{self.path} has no delivery")
        schema = wider_schema(T.StructType.fromJson(json.loads(k["schema"])) for k in kinds)
        entries = self.log.entries(spark)
        if names is not None:
            entries = entries.filter(F.col("id").isin(list(names)))
        parts = []
        for k in kinds:
            # the folders of one kind: what a listing of the table would give, no more
            folders = [r["folder"] for r in entries.filter((F.col("format") == k["format"]) & (F.col("schema") == k["schema"])
                                                           & (F.col("options") == k["options"])).orderBy("delivered").collect()]
            if folders:
                rows = spark.read.format(k["format"]).schema(T.StructType.fromJson(json.loads(k["schema"]))) \
                    .options(**json.loads(k["options"])).load(folders)
                parts.append(fitted_to(rows, schema))
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _folder(name: str) -> str:
    return f"{re.sub('[^A-Za-z0-9.-]', '-', name).lstrip('.-')}-{uuid.uuid4().hex[:12]}"
