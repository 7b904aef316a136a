"""Column expressions for text: sentinels, timestamps, damaged letters, model
names and yield reports.  All are built-in Spark expressions (no UDF), so they
stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# Text the raw registers use for a missing value.
NONE_SENTINEL = "None"
# Damaged letter in building purpose names: UTF-8 "á" read as Windows-1250.
DEFAULT_REPAIRS: tuple[tuple[str, str], ...] = (("Ăˇ", "á"),)
# Model-name normalisation: drop a greedy "(...) " group, then turn dots,
# dashes and white space into underscores.
MODEL_BRACKET_PATTERN = r"\(.*\) "
MODEL_SEPARATOR_PATTERN = r"[\.\-\s]"
# Yearly energy in a yield report: group 2 of this pattern (dot unescaped).
YEARLY_ENERGY_PATTERN = r"(Year\s+)(\d+.\d+)"
# Report values are divided by this before use.
YEARLY_ENERGY_DIVISOR = 1000.0


def nullif_sentinel(col: str | Column, sentinel: str = NONE_SENTINEL) -> Column:
    """``'None'`` (or another sentinel) becomes NULL; every other value is kept, as text.

    The column is cast to string first: a CSV reader may infer an all-numeric
    column as a number, and ANSI mode refuses to compare a number with 'None'.
    """
    return F.nullif(as_col(col).cast("string"), F.lit(sentinel))


def parse_timestamp(col: str | Column, sentinel: str = NONE_SENTINEL, fmt: str | None = None,
                    ntz: bool = True) -> Column:
    """Text to timestamp: the sentinel and unparseable text become NULL.

    The value is cast to string first, so a column that a CSV reader already
    inferred as timestamp passes through unchanged (ANSI mode would otherwise
    refuse to compare it with the sentinel).  With ``ntz`` the result is a
    TIMESTAMP_NTZ (wall-clock, independent of the session zone).
    """
    text = nullif_sentinel(as_col(col).cast("string"), sentinel)
    target = "timestamp_ntz" if ntz else "timestamp"
    if fmt is None:
        return text.try_cast(target)
    return F.try_to_timestamp(text, F.lit(fmt)).cast(target)


def repair_text(col: str | Column, pairs: Iterable[tuple[str, str]] = DEFAULT_REPAIRS) -> Column:
    """Replace each damaged sequence by its intended text (literal, not regex)."""
    out = as_col(col)
    for bad, good in pairs:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def misdecoded_pairs(letters: str, wrong_codec: str = "cp1250") -> list[tuple[str, str]]:
    """(damaged, intended) pairs for UTF-8 text that was decoded with ``wrong_codec``.

    ``misdecoded_pairs("á")`` gives the default pair above; pass a whole
    alphabet to repair every letter of it the same way.
    """
    pairs = []
    for letter in letters:
        try:
            bad = letter.encode("utf-8").decode(wrong_codec)
        except UnicodeDecodeError:
            continue
        if bad != letter:
            pairs.append((bad, letter))
    return pairs


def normalise_model_name(col: str | Column) -> Column:
    """Panel model name as the catalogue spells it (see the fixed patterns).

    Flags make Java read the patterns as Python does: ``(?d)`` lets ``.``
    stop only at ``\\n``, and ``(?U)`` makes ``\\s`` match Unicode white
    space (a no-break space, for one).
    """
    stripped = F.regexp_replace(as_col(col), "(?d)" + MODEL_BRACKET_PATTERN, "")
    return F.regexp_replace(stripped, "(?U)" + MODEL_SEPARATOR_PATTERN, "_")


def yearly_energy(body: str | Column) -> Column:
    """Yearly energy out of a report text, divided by 1000; NULL when absent.

    ``regexp_extract`` gives '' without a match and ``try_cast('')`` is NULL,
    so a report without the line yields NULL (never a -1 placeholder).
    """
    found = F.regexp_extract(as_col(body), "(?d)(?U)" + YEARLY_ENERGY_PATTERN, 2)
    return found.try_cast("double") / F.lit(YEARLY_ENERGY_DIVISOR)


def contains_ci(col: str | Column, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(as_col(col)).contains(needle.lower())
