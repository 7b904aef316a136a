"""Join of a large table to a dimension, plain or salted; the caller chooses.

``auto`` is a plain join: Spark broadcasts a side whose size it knows to be
small, and adaptive execution splits partitions that turn out skewed.
``salted`` and ``uniform`` spread hot keys by construction, for runs without
adaptive execution or plans in which it may not split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import fresh_name, name_col
from ..session import materialized

DEFAULT_SALT_BUCKETS = 32
# Rows of one key that one task of the salted join should handle at most.
DEFAULT_ROWS_PER_TASK = 5_000_000


def _row_salt(salts: Column, cols: list[str]) -> Column:
    """Salt of a row: a hash of its own values, so a recomputed task agrees."""
    return F.pmod(F.xxhash64(*[name_col(c) for c in cols]), salts)


def join_dimension(
    big: DataFrame,
    dim: DataFrame,
    on: str | list[str],
    how: str = "inner",
    *,
    strategy: str = "auto",
    rows_per_task: int = DEFAULT_ROWS_PER_TASK,
    salt_buckets: int = DEFAULT_SALT_BUCKETS,
    salt_from: list[str] | None = None,
) -> DataFrame:
    """Join a large table to a dimension (at most one row per key) on equal ``on`` columns.

    ``auto``: a plain join (see module doc).

    ``salted``: rows per key are counted first (a combinable aggregate, written
    once); a key with more than ``rows_per_task`` rows gets
    ``ceil(rows / rows_per_task)`` salts and its dimension row that many copies,
    every other key keeps one.  There are at most rows / ``rows_per_task`` hot
    keys, so their table is broadcast.  ``uniform``: ``salt_buckets`` salts for
    every key.  A row's salt is a hash of its own values (``salt_from`` columns,
    default all): a recomputed task sends every row to the same place.  Rows with
    a NULL key match nothing; those that a left join keeps are spread by the hash
    over ``salt_buckets`` salts as well.

    ``how`` is ``inner`` or ``left`` (rows of ``big`` are kept).
    """
    if how not in ("inner", "left", "left_outer"):
        raise ValueError("join_dimension supports inner and left joins")
    if strategy not in ("auto", "salted", "uniform"):
        raise ValueError("strategy is 'auto', 'salted' or 'uniform'")
    keys = [on] if isinstance(on, str) else list(on)
    if strategy == "auto":
        return big.join(dim, keys, how)
    cols = salt_from or big.columns
    n, salt_count, salt = (fresh_name([*big.columns, *dim.columns], c) for c in ("_n", "_salts", "_salt"))
    one = F.lit(1).cast("long")
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | name_col(k).isNull()

    if strategy == "uniform":
        salted_big = big.withColumn(salt_count, F.lit(salt_buckets).cast("long"))
        salted_dim = dim.withColumn(salt_count, F.lit(salt_buckets).cast("long"))
    else:
        hot = materialized(
            big.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
            .filter(F.col(n) > F.lit(rows_per_task))
            .select(*keys, F.ceil(F.col(n) / F.lit(rows_per_task)).cast("long").alias(salt_count)), "hot-keys")
        salted_big = big.join(F.broadcast(hot), keys, "left")
        salted_dim = dim.join(F.broadcast(hot), keys, "left")
    salts = F.when(no_key, F.lit(salt_buckets).cast("long")).otherwise(F.coalesce(salt_count, one))
    salted_big = salted_big.withColumn(salt, _row_salt(salts, cols)).drop(salt_count)
    salted_dim = salted_dim.withColumn(salt, F.explode(
        F.sequence(F.lit(0).cast("long"), F.coalesce(salt_count, one) - 1))).drop(salt_count)
    return salted_big.join(salted_dim, [*keys, salt], how).drop(salt)
