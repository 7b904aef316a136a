"""Small helpers shared by the operators: private column names and scratch tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def col(name: str) -> Column:
    """A column by its literal name (dots are not field access)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or with underscores appended until no taken column has it (any letter case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of files that every
    machine sees, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rooftop_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Remove a scratch table that nothing will read any more."""
    path = getattr(df, "_rooftop_path", None)
    if path:
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
