"""Semantic column types, missing values, and which operations a type allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED = {"string", "integer", "float", "decimal", "datetime", "date", "duration"}
NUMERIC = {"integer", "float", "decimal"}
GROUPABLE = ORDERED | {"boolean"}

_KINDS = (
    ("string", (T.StringType, T.VarcharType, T.CharType)),
    ("integer", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)),
    ("float", (T.FloatType, T.DoubleType)),
    ("decimal", (T.DecimalType,)),
    ("boolean", (T.BooleanType,)),
    ("datetime", (T.TimestampType, T.TimestampNTZType)),
    ("date", (T.DateType,)),
    ("duration", (T.DayTimeIntervalType,)),
    ("binary", (T.BinaryType,)),
    ("list", (T.ArrayType,)),
    ("struct", (T.StructType, T.MapType)),
)


class StepError(ValueError):
    """A step that can't be applied to this table."""


def semantic(kind: T.DataType) -> str:
    """One of the twelve semantic types; whole numbers wider than 64 bits are decimal(38,0) and count as integers."""
    if isinstance(kind, T.DecimalType) and kind.precision == 38 and kind.scale == 0:
        return "integer"
    return next((name for name, kinds in _KINDS if isinstance(kind, kinds)), "unknown")


def field(df: DataFrame, name: str) -> T.StructField:
    if name not in df.columns:
        raise StepError(f"no column {name!r}; there are {df.columns}")
    return df.schema[name]


def kind_of(df: DataFrame, name: str) -> str:
    return semantic(field(df, name).dataType)


def require(df: DataFrame, name: str, allowed: set[str], what: str) -> str:
    kind = kind_of(df, name)
    if kind not in allowed:
        raise StepError(f"{what} takes {', '.join(sorted(allowed))}; {name!r} is {kind}")
    return kind


def named(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a float column."""
    c = named(name)
    return (c.isNull() | F.isnan(c)) if kind_of(df, name) == "float" else c.isNull()


def valid(df: DataFrame, name: str) -> Column:
    """The column with its missing values as null."""
    c = named(name)
    return F.when(~F.isnan(c), c) if kind_of(df, name) == "float" else c


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def new_name(df: DataFrame, name: str, replaced: str | None = None) -> str:
    """`name`, if no other column has it, whatever the case."""
    taken = {c.lower() for c in df.columns if c != replaced}
    if not name or name.lower() in taken:
        raise StepError(f"column {name!r} is there already or has no name")
    return name


def rows_only(df: DataFrame, what: str) -> None:
    """Steps that need the whole table refuse a stream."""
    if df.isStreaming:
        raise StepError(f"{what} needs the whole table and can't run on a stream")


def schema_of(df: DataFrame) -> list[dict]:
    """Name, position, raw type, semantic type and nullability of each column."""
    return [{"name": f.name, "position": i, "rawType": f.dataType.simpleString(), "type": semantic(f.dataType), "nullable": f.nullable} for i, f in enumerate(df.schema.fields)]
