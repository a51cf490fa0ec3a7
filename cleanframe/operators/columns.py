"""Steps on columns and types. All are projections and run on streams as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanframe.functions.literals import literal
from cleanframe.functions.types import NUMERIC, StepError, kind_of, named, new_name, require
from cleanframe.functions.types import field as field_of
from cleanframe.plans.frame import HIDDEN, Frame

CASTS = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz"}
OPERATORS = ("add", "subtract", "multiply", "divide", "modulo", "power")


def select_columns(frame: Frame, columns: list[str]) -> Frame:
    for c in columns:
        field_of(frame.df, c)
    extra = [r.column for r in frame.order if r.column not in columns and r.column.startswith(HIDDEN)]
    return frame.with_df(frame.df.select(*[named(c) for c in [*columns, *extra]]))


def drop_columns(frame: Frame, columns: list[str]) -> Frame:
    for c in columns:
        field_of(frame.df, c)
    left = [c for c in frame.df.columns if c not in columns]
    if not [c for c in left if not c.startswith(HIDDEN)]:
        raise StepError("at least one column must stay")
    return frame.with_df(frame.df.select(*[named(c) for c in left]))


def rename_column(frame: Frame, column: str, new: str) -> Frame:
    field_of(frame.df, column)
    new_name(frame.df, new, column)
    out = frame.df.select(*[named(c).alias(new) if c == column else named(c) for c in frame.df.columns])
    order = tuple(type(r)(new, r.descending, r.nulls) if r.column == column else r for r in frame.order)
    return Frame(out, order)


def clone_column(frame: Frame, column: str, new: str) -> Frame:
    field_of(frame.df, column)
    return frame.with_df(frame.df.withColumn(new_name(frame.df, new), named(column)))


def cast_column(frame: Frame, column: str, dtype: str) -> Frame:
    """In place; what can't be read becomes null. Fractions are cut off on the way to integers."""
    kind = kind_of(frame.df, column)
    if dtype not in CASTS:
        raise StepError(f"no type {dtype!r} to cast to")
    c = named(column)
    if dtype == "integer" and kind == "float":
        out = F.when(~F.isnan(c) & (F.abs(c) < F.lit(2.0**63)), F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))).cast("bigint")
    else:
        out = c.try_cast(CASTS[dtype])
    return frame.with_df(frame.df.withColumn(column, out))


def formula(frame: Frame, left: str, operator: str, new: str, right: str | None = None, value: object = None) -> Frame:
    """`new` = left operator (column or value). Division and power give doubles, by IEEE rules.

    Integer arithmetic that overflows raises. An integer modulus of zero gives null, a double one NaN; the
    remainder has the sign of the left side.
    """
    df = frame.df
    kind = require(df, left, NUMERIC, "formula")
    if operator not in OPERATORS:
        raise StepError(f"no operator {operator!r}")
    a = named(left)
    if right is not None:
        other = require(df, right, NUMERIC, "formula")
        b = named(right)
    else:
        fraction = isinstance(value, float) and not float(value).is_integer()
        other = "float" if isinstance(value, float) else kind
        b = F.lit(float(value)) if fraction or other == "float" or kind == "float" else literal(value, field_of(df, left).dataType)
    double = "float" in (kind, other)
    if operator in ("divide", "power") or double:
        a, b = a.cast("double"), b.cast("double")
    if operator == "add":
        out = a + b
    elif operator == "subtract":
        out = a - b
    elif operator == "multiply":
        out = a * b
    elif operator == "divide":
        infinite = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        out = F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, infinite).otherwise(F.try_divide(a, b))
    elif operator == "power":
        out = F.pow(a, b)
    else:
        out = F.try_mod(a, b)
        if double:
            out = F.when((b == 0) & a.isNotNull(), F.lit(float("nan"))).otherwise(out)
    return frame.with_df(df.withColumn(new_name(df, new), out))


def text_length(frame: Frame, column: str, new: str) -> Frame:
    """Code points of the column's text form; null stays null."""
    field_of(frame.df, column)
    return frame.with_df(frame.df.withColumn(new_name(frame.df, new), F.length(named(column).cast("string")).cast("long")))
