"""Upkeep of a stored register and of the latest addresses by what a new delivery changed.

The stored rows lie in buckets of their key with a digest of each row.  A full
delivery is compared with them by a full outer join on the key: every row is
``new``, ``changed``, ``gone`` or ``same``.  The stored side is read in its buckets,
so it is neither shuffled nor sorted again; the delivery is shuffled to the same
buckets and hashed.  From the changes follow the houses whose addresses can be
different; those are derived again from the delivered registers, all other
addresses are taken from the stored table.

Defined results: rows with one key are matched in the order of their digests; a
row with NULL in its key matches nothing (it is ``gone`` and ``new`` at every
delivery).  Two rows are the same if 96 bits of hashes over all their values agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions._util import name_col
from .addresses import latest_addresses

NEW, CHANGED, GONE, SAME = "new", "changed", "gone", "same"
DIGEST, COPY = "row_digest", "row_copy"


def row_digest(columns: Sequence[str]) -> Column:
    """Hashes of a row's values and of which of them are NULL (a hash passes over NULLs)."""
    cols = [name_col(c) for c in columns]
    nulls = [c.isNull() for c in cols]
    return F.concat_ws(":", F.xxhash64(*cols, *nulls), F.hash(*nulls, *cols))


class KeyedStore:
    """A register kept in ``buckets`` buckets of its ``keys`` under ``path``.

    The buckets are described in the session's catalogue by a table of a random
    name over the path; the data is plain Parquet.
    """

    def __init__(self, path: str, keys: Sequence[str], buckets: int = 8):
        self.path, self.keys, self.buckets = path.rstrip("/"), tuple(keys), int(buckets)
        self.table = f"rooftop_store_{uuid.uuid4().hex}"

    def prepared(self, df: DataFrame) -> DataFrame:
        """``df`` with each row's digest and its number among the rows of its key."""
        marked = df.withColumn(DIGEST, row_digest(df.columns))
        same_key = Window.partitionBy(*[name_col(k) for k in self.keys]).orderBy(DIGEST)
        return marked.withColumn(COPY, F.row_number().over(same_key))

    def write(self, df: DataFrame) -> None:
        """Store ``df`` (rewrites the folder)."""
        (self.prepared(df).repartition(self.buckets, *[name_col(k) for k in self.keys])  # a file for each bucket
         .write.mode("overwrite").format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
         .option("path", self.path).saveAsTable(self.table))

    def read(self, spark: SparkSession) -> DataFrame:
        """The stored rows."""
        return spark.table(self.table).drop(DIGEST, COPY)

    def changes(self, delivered: DataFrame) -> DataFrame:
        """change, before (struct of the stored row or NULL), after (struct of the delivered row or NULL)."""
        spark = delivered.sparkSession
        old, new = spark.table(self.table), self.prepared(delivered)
        columns = [c for c in old.columns if c not in (DIGEST, COPY)]
        if sorted(columns) != sorted(delivered.columns):
            raise ValueError(f"stored columns {columns}, delivered {delivered.columns}")

        def side(df: DataFrame, name: str) -> DataFrame:
            return df.select(*[name_col(k).alias(f"{name}_{i}") for i, k in enumerate(self.keys)],
                             F.struct(*[name_col(c) for c in columns]).alias(name),
                             F.col(DIGEST).alias(f"{name}_digest"), F.col(COPY).alias(f"{name}_copy"))

        a, b = side(old, "before"), side(new, "after")
        # equal copy numbers as two inequalities: the join stays on the bucketed key alone
        match = (F.col("before_copy") <= F.col("after_copy")) & (F.col("before_copy") >= F.col("after_copy"))
        for i in range(len(self.keys)):
            match = match & (F.col(f"before_{i}") == F.col(f"after_{i}"))
        joined = a.join(b.hint("shuffle_hash"), match, "full_outer")
        change = F.when(F.col("before").isNull(), NEW).when(F.col("after").isNull(), GONE) \
            .when(F.col("before_digest") == F.col("after_digest"), SAME).otherwise(CHANGED)
        return joined.select(change.alias("change"), "before", "after")

    def updated(self, changes: DataFrame) -> DataFrame:
        """The register after the changes: the stored rows that are the same, and the new forms of the others."""
        return changes.filter(F.col("change") != GONE).select(
            F.when(F.col("change") == SAME, F.col("before")).otherwise(F.col("after")).alias("r")).select("r.*")


def affected_houses(entrance_changes: DataFrame | None = None, building_changes: DataFrame | None = None,
                    link: str = "propertyRegistrationNumberIdentifier", house: str = "objectId") -> DataFrame:
    """``houseObjectId`` of every house one of whose entrances or building rows is not the same as before."""
    parts = []
    for changes, column in ((entrance_changes, link), (building_changes, house)):
        if changes is not None:
            ends = changes.filter(F.col("change") != SAME).select(
                F.explode(F.array(F.col("before").getField(column), F.col("after").getField(column))).alias("houseObjectId"))
            parts.append(ends.filter(F.col("houseObjectId").isNotNull()))
    if not parts:
        raise ValueError("no changes given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def refreshed_addresses(stored: DataFrame, affected: DataFrame, entrances: DataFrame, buildings: DataFrame,
                        municipalities: DataFrame, **options) -> DataFrame:
    """The latest addresses after a delivery: those of the affected houses anew, the others from the stored table.

    ``options`` are those of ``latest_addresses``, as for the stored table (a row
    limit excepted: a cut is not a function of a house alone).  Changes of the
    municipalities' names need a full derivation.
    """
    if options.get("limit") is not None:
        raise ValueError("a cut table cannot be kept up by houses")
    houses = affected.select("houseObjectId")
    again = latest_addresses(
        entrances.join(houses, entrances["propertyRegistrationNumberIdentifier"] == houses["houseObjectId"], "left_semi"),
        buildings.join(houses, buildings["objectId"] == houses["houseObjectId"], "left_semi"),
        municipalities, **options)
    return stored.join(houses, "houseObjectId", "left_anti").select(*again.columns).unionByName(again)
