"""One schema out of many: the union of columns, each in the narrowest type that holds all its forms.

Widening keeps every value: whole numbers to longer ones, to decimals with room
for their digits, and (up to 32 bits) to double; float to double; decimals to
more digits; date to timestamp without zone; nothing (void) to anything; arrays,
maps and structs by their parts.  Anything else, a 64-bit number and a double for
one, is a ``SchemaConflict``: a caller who wants text or rounding casts first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# whole numbers, narrowest first, and the decimal digits each may have
_WHOLE: dict[type, int] = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
_FRACTION: tuple[type, ...] = (T.FloatType, T.DoubleType)
MAX_DIGITS = 38


class SchemaConflict(ValueError):
    """Two forms of a column that no type holds without loss."""


def wider_type(a: T.DataType, b: T.DataType, where: str = "") -> T.DataType:
    """The narrowest type for values of both types."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    ka, kb = type(a), type(b)
    if ka in _WHOLE and kb in _WHOLE:
        return a if _WHOLE[ka] > _WHOLE[kb] else b
    if ka in _FRACTION and kb in _FRACTION:
        return T.DoubleType()
    whole = [k for k in (ka, kb) if k in _WHOLE]
    if whole and (ka in _FRACTION or kb in _FRACTION) and whole[0] is not T.LongType:
        return T.DoubleType()
    if (whole or ka is kb) and T.DecimalType in (ka, kb):
        sizes = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (_WHOLE[type(t)], 0) for t in (a, b)]
        digits, scale = max(s[0] for s in sizes), max(s[1] for s in sizes)
        if digits + scale <= MAX_DIGITS:
            return T.DecimalType(digits + scale, scale)
    if {ka, kb} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if ka is kb is T.ArrayType:
        return T.ArrayType(wider_type(a.elementType, b.elementType, f"{where}[]"), True)
    if ka is kb is T.MapType:
        return T.MapType(wider_type(a.keyType, b.keyType, f"{where} key"),
                         wider_type(a.valueType, b.valueType, f"{where} value"), True)
    if ka is kb is T.StructType:
        return wider_schema([a, b], where)
    raise SchemaConflict(f"{where or 'column'}: no type holds both {a.simpleString()} and {b.simpleString()}")


def wider_schema(schemas: Iterable[T.StructType], where: str = "") -> T.StructType:
    """All columns of the schemas, in the order in which they first appear; every column may be NULL.

    Names that differ in letter case alone are a conflict (Spark would take them for one).
    """
    merged: dict[str, T.DataType] = {}
    spelled: dict[str, str] = {}
    for schema in schemas:
        for f in schema.fields:
            if spelled.setdefault(f.name.lower(), f.name) != f.name:
                raise SchemaConflict(f"{where}{'.' if where else ''}{f.name} is also written {spelled[f.name.lower()]}")
            path = f"{where}.{f.name}" if where else f.name
            merged[f.name] = wider_type(merged[f.name], f.dataType, path) if f.name in merged else f.dataType
    return T.StructType([T.StructField(n, t, True) for n, t in merged.items()])


def _fitted(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value of type ``have`` as ``want``, by parts where a struct has gained fields."""
    if isinstance(want, T.StructType) and have != want:
        names = {f.name: f.dataType for f in have.fields}
        parts = [(_fitted(c.getField(f.name), names[f.name], f.dataType) if f.name in names else F.lit(None).cast(f.dataType))
                 .alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType) and have != want:
        return F.transform(c, lambda x: _fitted(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and have != want:
        values = F.transform_values(c, lambda _, v: _fitted(v, have.valueType, want.valueType))
        return values.cast(want)
    return c if have == want else c.cast(want)


def fitted_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns and types of a wider schema; a column it lacks is NULL."""
    have = {f.name: f.dataType for f in df.schema.fields}
    quoted = {n: F.col("`" + n.replace("`", "``") + "`") for n in have}
    return df.select(*[
        (_fitted(quoted[f.name], have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])
