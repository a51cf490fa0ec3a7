"""Strict typed literals: the few values that a filter or a fill names."""

from __future__ import annotations

import datetime as dt
import math
import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.types import StepError, semantic

_NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
_DAY = r"\d{4}-\d\d-\d\d"
_CLOCK = r"([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?"
#: The text forms of each type, matched in full: no blanks, no digit separators, no other spellings.
_FORMS = {
    "integer": re.compile(r"[+-]?\d+"),
    "float": re.compile(rf"{_NUMBER}|[+-]?Infinity"),
    "decimal": re.compile(_NUMBER),
    "date": re.compile(_DAY),
    "datetime": re.compile(rf"{_DAY}([T ]{_CLOCK}(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)?)?"),
}
#: Seconds, or days and a time of day.
_SECONDS = re.compile(r"[+-]?(\d+(\.\d{0,6})?|\.\d{1,6})")
_SPAN = re.compile(r"((?P<days>-?\d+) days?, )?(?P<h>\d|[01]\d|2[0-3]):(?P<m>[0-5]\d):(?P<s>[0-5]\d(\.\d{1,6})?)")


def _duration(text: str) -> dt.timedelta:
    if _SECONDS.fullmatch(text):
        return dt.timedelta(microseconds=int(Decimal(text).scaleb(6)))
    m = _SPAN.fullmatch(text)
    if not m:
        raise ValueError(text)
    clock = Decimal(m["s"]) + 60 * int(m["m"]) + 3600 * int(m["h"])
    return dt.timedelta(days=int(m["days"] or 0), microseconds=int(clock.scaleb(6)))


def parse(value: object, kind: T.DataType) -> object:
    """`value` (its text or its Python value) as a value of `kind`; raises StepError where it isn't one.

    Booleans may have blanks around them, all other texts have exactly the form of their type. NaN is no literal,
    and a number too large for a double is none but as `Infinity`. A day alone is its midnight.
    """
    name = semantic(kind)
    if name == "string":
        return str(value)
    own = {"boolean": bool, "date": dt.date, "datetime": dt.datetime, "duration": dt.timedelta}.get(name)
    if own and isinstance(value, own) and not (name == "date" and isinstance(value, dt.datetime)):
        text = None
    elif isinstance(value, bool):
        raise StepError(f"{value!r} is no {name} value")
    else:
        text = str(value)
        if name in _FORMS and not _FORMS[name].fullmatch(text):
            raise StepError(f"{value!r} is no {name} value")
    try:
        if name == "boolean":
            return value if text is None else {"true": True, "false": False}[text.strip().lower()]
        if name == "integer":
            number = int(text)
            if abs(number) >= 10**38:
                raise ValueError(value)
            return number
        if name == "float":
            number = float(text)
            if math.isinf(number) and not text.endswith("Infinity"):
                raise ValueError(value)
            return number
        if name == "decimal":
            number = Decimal(text)
            if -number.as_tuple().exponent > kind.scale and number != round(number, kind.scale):
                raise ValueError(value)
            return number
        if name == "date":
            return value if text is None else dt.date.fromisoformat(text)
        if name == "datetime":
            moment = value if text is None else dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
            if (moment.tzinfo is not None) != isinstance(kind, T.TimestampType) and not (moment.tzinfo is None and isinstance(kind, T.TimestampType)):
                raise ValueError(value)
            return moment
        if name == "duration":
            return value if text is None else _duration(text)
    except (ValueError, KeyError, OverflowError, InvalidOperation) as e:
        raise StepError(f"{value!r} is no {name} value") from e
    raise StepError(f"{name} columns take no literals")


def literal(value: object, kind: T.DataType) -> Column:
    """`parse` as a typed column; numbers too large for the type are compared as decimals."""
    parsed = parse(value, kind)
    if semantic(kind) == "integer":
        return F.lit(Decimal(parsed)).cast("decimal(38,0)") if abs(parsed) >= 2**63 else F.lit(parsed).cast(kind if abs(parsed) < 2**31 or isinstance(kind, (T.LongType, T.DecimalType)) else "long")
    if isinstance(parsed, Decimal):
        return F.lit(str(parsed)).cast(kind)
    return F.lit(parsed).cast(kind)
