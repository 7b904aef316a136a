"""Global row numbering without a single-partition window.

``row_number() OVER (ORDER BY key)`` with no PARTITION BY moves every row into
one task.  Here the rows are dealt to range partitions and numbered there:

1. ``repartitionByRange`` over the whole order: key, tie-breaks, and last the
   row's place in the input.  Spark samples this order for the bounds, so a
   key value (or NULL) with a third of the rows, or rows equal in every
   tie-break, are split like any others, and a far-off key moves no bound.
   There are as many ranges as the session's shuffle partitions, and adaptive
   execution joins small neighbours; no count of the rows is needed;
2. rows are sorted in their partition and written once, with the partition's
   number and their position in it, as a table in the shared scratch folder;
3. per-partition counts give running offsets (one row per partition: broadcast),
   and number = offset + position.

NULL keys come first, as in ascending SQL order.  Rows equal in key and
tie-breaks are numbered in input order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions._util import fresh_name, name_col
from ..session import materialized

_LOCAL_BITS = (1 << 33) - 1


def global_row_number(
    df: DataFrame,
    key: str,
    out: str = "rn",
    tiebreak: Sequence[str] = (),
    rows_per_range: int | None = None,
    materialize: bool = False,
) -> DataFrame:
    """Add ``out`` = 1-based row number in (key, *tiebreak) order (see module doc).

    ``df`` is read twice (range sampling, shuffle).  With ``materialize`` it is
    first written to the shared scratch folder and both passes read that copy;
    use it when ``df`` is an expensive plan.  ``rows_per_range`` fixes the size
    of the ranges, for one more pass that counts the rows.
    """
    if materialize:
        df = materialized(df, "to-number")
    place, part, pos, n, offset = (fresh_name([*df.columns, out], c) for c in ("_place", "_part", "_pos", "_n", "_offset"))
    order = [name_col(c).asc_nulls_first() for c in (key, *tiebreak)]
    parts = [] if rows_per_range is None else [max(1, math.ceil(df.count() / max(1, int(rows_per_range))))]
    placed = materialized(
        df.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(*parts, *order, place)
        .sortWithinPartitions(*order, place).drop(place)
        .select("*", F.spark_partition_id().alias(part),
                F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS)).alias(pos)), "numbered")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(offset))
    return (
        placed.join(F.broadcast(offsets), part, "inner")
        .withColumn(out, (F.col(offset) + F.col(pos) + F.lit(1)).cast("long"))
        .drop(part, pos, offset)
    )
