"""Raw text files read with their malformed rows routed aside, each with a reason.

The original job stops at the first row that is not of its types; that stays the
default elsewhere (``FAILFAST``).  Here every row is read as text, checked, and
written once, into the good or the rejected part of one scratch table, so a
large file is read a single time for both.  Counts by reason are observed while
the rows are written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import fresh_name, name_col
from ..session import scratch_path
from .tables import Format, TableIn

# Reasons beside the names of the caller's checks.
FIELDS, TYPE, MISSING = "fields", "type", "missing"


@dataclass(frozen=True)
class Routed:
    """``good``: rows of the schema; ``rejects``: reason, column and the raw fields as text (``raw``: a row that
    has the wrong number of fields or is no JSON, whole); ``counts``: rows by reason (``good`` for good ones)."""

    good: DataFrame
    rejects: DataFrame
    counts: Mapping[str, int]


def read_routed(
    spark: SparkSession,
    source: TableIn,
    schema: T.StructType | str,
    *,
    required: Sequence[str] = (),
    checks: Mapping[str, Column] | None = None,
) -> Routed:
    """Read a CSV or JSON table of ``schema``; route what does not fit (see module doc).

    Reasons, the first that holds: ``fields`` (not as many fields as columns; no
    JSON), ``type`` (a text that is no value of its column's type; a number that
    the type cannot hold), ``missing`` (NULL in a ``required`` column), then the
    caller's ``checks`` by name: conditions over the typed columns that a good row
    does not break (NULL does not break one).
    """
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fmt = Format(source.format)
    if fmt not in (Format.CSV, Format.JSON):
        raise ValueError("only text formats have rows that do not fit")
    checks = dict(checks or {})
    reserved = {FIELDS, TYPE, MISSING, "good"} & set(checks)
    if reserved:
        raise ValueError(f"check names {sorted(reserved)} are reasons of their own")
    whole = fresh_name(want.names, "_raw")
    text = T.StructType([*[T.StructField(n, T.StringType()) for n in want.names], T.StructField(whole, T.StringType())])
    options = {**source.options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": whole}
    reader = TableIn(source.path, format=fmt, schema=text, header=source.header, sep=source.sep, encoding=source.encoding,
                     enforce_schema=True, options=options)
    raw = reader.read(spark)

    typed = {f.name: name_col(f.name).try_cast(f.dataType) for f in want.fields}
    bad_type, bad_column = F.lit(False), F.lit(None).cast("string")
    missing, missing_column = F.lit(False), F.lit(None).cast("string")
    for f in reversed(want.fields):
        wrong = name_col(f.name).isNotNull() & typed[f.name].isNull()
        bad_type, bad_column = bad_type | wrong, F.when(wrong, F.lit(f.name)).otherwise(bad_column)
    for n in reversed(list(required)):
        empty = name_col(n).isNull()
        missing, missing_column = missing | empty, F.when(empty, F.lit(n)).otherwise(missing_column)
    routed = raw.select(F.struct(*[name_col(n) for n in want.names]).alias("t"), name_col(whole).alias("raw"),
                        F.struct(*[c.alias(n) for n, c in typed.items()]).alias("v"),
                        F.when(name_col(whole).isNotNull(), F.lit(FIELDS)).when(bad_type, F.lit(TYPE))
                        .when(missing, F.lit(MISSING)).alias("reason"),
                        F.when(name_col(whole).isNotNull(), F.lit(None)).when(bad_type, bad_column)
                        .when(missing, missing_column).alias("column"))
    # the caller's conditions see the typed columns under their own names
    seen = routed.select("t", "raw", "v", "reason", "column", *[F.col("v").getField(n).alias(n) for n in want.names
                                                               if n not in ("t", "raw", "v", "reason", "column")])
    reason = F.col("reason")
    for name, condition in checks.items():
        reason = F.when(reason.isNull() & ~F.coalesce(condition, F.lit(True)), F.lit(name)).otherwise(reason)
    final = seen.select("t", "raw", "v", reason.alias("reason"), "column", reason.isNull().alias("good"))
    counted = Observation("routed")
    final = final.observe(counted, F.count(F.when(F.col("good"), 1)).alias("good"), *[
        F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in (FIELDS, TYPE, MISSING, *checks)])
    path = scratch_path(spark, "routed")
    final.write.partitionBy("good").parquet(path)
    back = spark.read.schema(final.schema).parquet(path)
    return Routed(back.filter(F.col("good")).select("v.*"),
                  back.filter(~F.col("good")).select("reason", "column", "t.*", "raw"),
                  dict(counted.get))
