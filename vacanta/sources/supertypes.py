"""The least type that holds the values of several, over nested types, and tables brought to it.

Numbers widen to the larger number, dates to timestamps, a truth value next to numbers becomes 0 or 1, and
scalars that have nothing else in common become text. Structs take the fields of all, by name; arrays and
maps take the common type of their elements. A nested type and a scalar have no common type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits of the integer types; fixed values.
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONS = (T.FloatType, T.DoubleType)
_NUMBERS = (*_INTEGERS, *_FRACTIONS, T.DecimalType)
_TIMES = (T.DateType, T.TimestampNTZType, T.TimestampType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


class NoCommonType(TypeError):
    """Two columns of one name whose types have no common one."""


def _decimal(kind: T.DataType) -> tuple[int, int]:
    """Digits before and after the point."""
    return (kind.precision - kind.scale, kind.scale) if isinstance(kind, T.DecimalType) else (_DIGITS[kind.simpleString()], 0)


def common_type(a: T.DataType, b: T.DataType, where: str = "column") -> T.DataType:
    """The least type that holds the values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return common_struct(a, b, where)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType, f"{where}[]"), a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType, f"{where} keys"), common_type(a.valueType, b.valueType, f"{where} values"), a.valueContainsNull or b.valueContainsNull)
    if isinstance(a, _NESTED) or isinstance(b, _NESTED):
        raise NoCommonType(f"{where}: {a.simpleString()} and {b.simpleString()}")
    if isinstance(a, T.BooleanType) and isinstance(b, _NUMBERS):
        return b
    if isinstance(b, T.BooleanType) and isinstance(a, _NUMBERS):
        return a
    if isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS):
        if isinstance(a, _FRACTIONS) or isinstance(b, _FRACTIONS):
            # A float holds two bytes of an integer whole, and no more.
            small = (T.FloatType, T.ByteType, T.ShortType)
            return T.FloatType() if isinstance(a, small) and isinstance(b, small) else T.DoubleType()
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            (before, after), (before_b, after_b) = _decimal(a), _decimal(b)
            before, after = max(before, before_b), max(after, after_b)
            return T.DecimalType(before + after, after) if before + after <= 38 else T.DoubleType()
        return max(a, b, key=lambda kind: _DIGITS[kind.simpleString()])
    if isinstance(a, _TIMES) and isinstance(b, _TIMES):
        return max(a, b, key=lambda kind: _TIMES.index(type(kind)))
    if T.BinaryType() in (a, b) and T.StringType() in (a, b):
        return T.BinaryType()
    if T.BinaryType() in (a, b):
        raise NoCommonType(f"{where}: {a.simpleString()} and {b.simpleString()}")
    return T.StringType()


def common_struct(a: T.StructType, b: T.StructType, where: str = "", case_sensitive: bool = False) -> T.StructType:
    """Fields of both by name, in the order in which they first appear."""
    name = (lambda f: f.name) if case_sensitive else (lambda f: f.name.lower())
    own, other = {name(f): f for f in a.fields}, {name(f): f for f in b.fields}
    out = []
    for key, f in (own | {k: f for k, f in other.items() if k not in own}).items():
        kind = common_type(own[key].dataType, other[key].dataType, f"{where}.{f.name}".lstrip(".")) if key in own and key in other else f.dataType
        out.append(T.StructField(f.name, kind, True))
    return T.StructType(out)


def _conformed(c: Column, have: T.DataType, want: T.DataType, case_sensitive: bool) -> Column:
    if have == want:
        return c
    if isinstance(want, T.StructType):
        name = (lambda n: n) if case_sensitive else str.lower
        there = {name(f.name): f for f in have.fields} if isinstance(have, T.StructType) else {}
        fields = [
            (_conformed(c[there[name(f.name)].name], there[name(f.name)].dataType, f.dataType, case_sensitive) if name(f.name) in there else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields)) if isinstance(have, T.StructType) else F.lit(None).cast(want)
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda e: _conformed(e, have.elementType, want.elementType, case_sensitive))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        entry = lambda e: F.struct(
            _conformed(e["key"], have.keyType, want.keyType, case_sensitive).alias("key"), _conformed(e["value"], have.valueType, want.valueType, case_sensitive).alias("value")
        )
        return F.map_from_entries(F.transform(F.map_entries(c), entry))
    if isinstance(have, T.BooleanType) and isinstance(want, T.DecimalType):
        return c.cast("int").cast(want)
    return c.cast(want)


def conform(df: DataFrame, schema: T.StructType, case_sensitive: bool = False) -> DataFrame:
    """``df`` with the columns of ``schema``: missing ones null, others in their wider type."""
    name = (lambda n: n) if case_sensitive else str.lower
    there = {name(f.name): f for f in df.schema.fields}
    out = []
    for f in schema.fields:
        own = there.get(name(f.name))
        c = F.lit(None).cast(f.dataType) if own is None else _conformed(F.col(f"`{own.name}`"), own.dataType, f.dataType, case_sensitive)
        out.append(c.alias(f.name))
    return df.select(out)
