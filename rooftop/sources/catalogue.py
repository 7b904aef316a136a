"""Panel catalogue and approved-panel list as tables.

A catalogue file has one row per model with the model name in a column
called ``index`` (how a transposed attribute table is written out); it becomes
``panel_name``, and all other attributes stay.  A file in the other orientation (one row per attribute, one
column per model) is turned around with ``unpivot`` + ``pivot``: the attribute
list is given, so the pivot needs no extra pass to find its values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Format, TableIn, TableOut

# Columns every catalogue has; a file may have others, in any order.
CATALOGUE_COLUMNS = {"index": "string", "STC": "double", "Technology": "string"}


def read_catalogue(spark: SparkSession, path: str, fmt: Format = Format.CSV, **kw) -> DataFrame:
    """Catalogue table with ``panel_name`` (renamed from ``index``), ``STC``, ``Technology`` and all other attributes.

    Columns are taken by their names.  CSV attributes other than ``STC`` stay
    text; a text that is not a number makes ``STC`` NULL.  A file without one of
    the required columns is an error.
    """
    if fmt is Format.CSV:
        kw = {"infer_schema": False, **kw}
    df = TableIn(path, format=fmt, **kw).read(spark)
    missing = [c for c in CATALOGUE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"the catalogue has no column {missing}")
    rest = [f"`{c}`" for c in df.columns if c not in CATALOGUE_COLUMNS]
    return df.select(F.col("index").cast("string").alias("panel_name"), F.col("STC").try_cast("double").alias("STC"),
                     F.col("Technology").cast("string").alias("Technology"), *rest)


def models_to_rows(wide: DataFrame, attribute_col: str, attributes: Sequence[str],
                   model_cols: Sequence[str] | None = None, value_type: str = "string") -> DataFrame:
    """Attribute-per-row / model-per-column table -> one row per model.

    Output: ``panel_name`` plus one column per listed attribute (values of
    ``value_type``; cast further as needed).
    """
    models = [c for c in (model_cols or wide.columns) if c != attribute_col]
    long = wide.select(
        F.col(attribute_col).alias("_attr"),
        *[F.col(f"`{m}`").cast(value_type).alias(m) for m in models],
    ).unpivot("_attr", models, "panel_name", "_value")
    return long.groupBy("panel_name").pivot("_attr", list(attributes)).agg(F.first("_value"))


def migrate_table(spark: SparkSession, source: TableIn, target: TableOut) -> DataFrame:
    """Copy a table as it is (the approved-panel list); returns what was written."""
    df = source.read(spark)
    target.write(df)
    return df
