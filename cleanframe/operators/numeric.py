"""Scalar steps on numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cleanframe.functions.types import NUMERIC, StepError, kind_of, named, new_name, require, rows_only
from cleanframe.functions.types import field as field_of
from cleanframe.plans.frame import Frame

#: strftime directives and Spark's patterns (fixed values).
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "j": "DDD", "p": "a"}


def _put(frame: Frame, column: str, new: str | None, out: Column) -> Frame:
    return frame.with_df(frame.df.withColumn(column if new is None else new_name(frame.df, new), out))


def finite(c: Column) -> Column:
    """A double as it is, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def min_max_scale(frame: Frame, column: str, new: str | None = None) -> Frame:
    """(value - min) / (max - min) over finite values; a constant column gives 0, non-finite values null.

    One aggregate finds the ends, which are put back as a one-row broadcast: no window over the table. Whole
    numbers and decimals are subtracted exactly before the division.
    """
    rows_only(frame.df, "minMaxScale")
    kind = require(frame.df, column, NUMERIC, "minMaxScale")
    c = finite(named(column).cast("double")) if kind == "float" else named(column).cast("decimal(38,0)") if kind == "integer" else named(column)
    ends = frame.df.agg(F.min(c).alias("__low"), F.max(c).alias("__high"))
    low, high = F.col("__low"), F.col("__high")
    part = (c - low).cast("double") / (high - low).cast("double")
    scaled = F.when(c.isNull(), F.lit(None).cast("double")).when(high == low, F.lit(0.0)).otherwise(part)
    joined = frame.df.crossJoin(F.broadcast(ends))
    name = column if new is None else new_name(frame.df, new)
    return frame.with_df(joined.withColumn(name, scaled).drop("__low", "__high"))


def round_number(frame: Frame, column: str, decimals: int = 0, new: str | None = None) -> Frame:
    """Ties go to the even digit; negative decimals round to tens and hundreds. A double."""
    require(frame.df, column, NUMERIC, "roundNumber")
    c = named(column).cast("double")
    return _put(frame, column, new, F.when(finite(c).isNull(), c).otherwise(F.bround(c, decimals)))


def floor_number(frame: Frame, column: str, new: str | None = None) -> Frame:
    require(frame.df, column, NUMERIC, "floorNumber")
    c = named(column).cast("double")
    # beyond 2**53 a double is whole, and floor() would leave the range of its long result
    return _put(frame, column, new, F.when(F.abs(c) < F.lit(2.0**53), F.floor(c).cast("double")).otherwise(c))


def ceil_number(frame: Frame, column: str, new: str | None = None) -> Frame:
    require(frame.df, column, NUMERIC, "ceilNumber")
    c = named(column).cast("double")
    return _put(frame, column, new, F.when(F.abs(c) < F.lit(2.0**53), F.ceil(c).cast("double")).otherwise(c))


def spark_pattern(format: str) -> str:
    """A strftime format as a Spark datetime pattern; unknown directives are errors."""
    out, at = "", 0
    while at < len(format):
        ch = format[at]
        if ch == "%":
            code = format[at + 1 : at + 2]
            if code == "%":
                out += "%"
            elif code in DIRECTIVES:
                out += DIRECTIVES[code]
            else:
                raise StepError(f"no directive %{code}")
            at += 2
            continue
        out += f"'{ch}'" if ch.isalpha() else "''" if ch == "'" else ch if ch not in "[]{}#" else f"'{ch}'"
        at += 1
    return out


def format_datetime(frame: Frame, column: str, format: str, new: str | None = None) -> Frame:
    """Text of a date or time by a strftime format; text that is no time gives null."""
    field_of(frame.df, column)
    kind, c = kind_of(frame.df, column), named(column)
    moment = c if kind in ("date", "datetime") else c.cast("string").try_cast("timestamp_ntz")
    return _put(frame, column, new, F.date_format(moment, spark_pattern(format)))
