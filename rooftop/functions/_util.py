from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_col(name: str) -> Column:
    """A column by its literal name (dots are not field access)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_name(taken: Iterable[str], name: str) -> str:
    """``name``, or with underscores appended until none of the names taken equals it (in any letter case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name
