"""Group by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.types import GROUPABLE, NUMERIC, ORDERED, StepError, all_of, kind_of, named, require, rows_only, valid
from cleanframe.plans.frame import ROW, Frame, SortRule
from cleanframe.plans.ranges import group_middles

ALLOWED = {"sum": NUMERIC, "mean": NUMERIC, "median": NUMERIC, "min": ORDERED, "max": ORDERED, "count": GROUPABLE, "nUnique": GROUPABLE, "first": GROUPABLE, "last": GROUPABLE}


@dataclass(frozen=True)
class Aggregation:
    column: str
    operation: str
    alias: str


def _column(df: DataFrame, a: Aggregation, position: Column | None) -> Column:
    kind = require(df, a.column, ALLOWED[a.operation], a.operation)
    v = valid(df, a.column)
    if a.operation == "sum":
        # whole numbers to 38 digits, overflow raises; an empty group sums to 0
        exact = F.sum(v.cast("decimal(38,0)") if kind == "integer" else v)
        return F.coalesce(exact, F.lit(0).cast("decimal(38,0)" if kind == "integer" else "double" if kind == "float" else df.schema[a.column].dataType))
    if a.operation == "mean":
        return F.avg(v).cast("double")
    if a.operation in ("min", "max"):
        return (F.min if a.operation == "min" else F.max)(v)
    if a.operation == "count":
        return F.count(v)
    if a.operation == "nUnique":
        return F.countDistinct(v)
    pick = F.min_by if a.operation == "first" else F.max_by
    return pick(v, F.when(v.isNotNull(), position))


def _with_medians(out: DataFrame, df: DataFrame, by: list[Column], keys: list[str], wanted: list[Aggregation], buckets: int | None) -> DataFrame:
    """`out` and its groups' medians as doubles: the middle values by rank, all groups at once, joined back by key."""
    names = [f"__k{i}" for i in range(len(keys))]
    for column in dict.fromkeys(a.column for a in wanted):
        middles = group_middles(df, by, names, valid(df, column).cast("double"), buckets)
        made = middles.select(*names, *[(F.col("__low") / 2 + F.col("__high") / 2).alias(a.alias) for a in wanted if a.column == column])
        out = out.join(made, all_of([named(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]), "left").drop(*names)
    return out


def group_by(frame: Frame, keys: list[str], aggregations: list[Aggregation], ordered: bool = False, buckets: int | None = None) -> Frame:
    """Keys, then the aggregates' aliases. Aggregates skip missing values; NaN keys join null.

    `first` and `last` go by the frame's order. With `ordered` groups have the order of their first rows: their least
    position, an aggregate like the others, is hidden in the result and is the order of the steps that follow. No median is
    gathered in a group's buffer: see `group_middles`.
    """
    rows_only(frame.df, "groupBy")
    names = [k.lower() for k in keys]
    for a in aggregations:
        if a.operation not in ALLOWED:
            raise StepError(f"no aggregate {a.operation!r}")
        if a.alias.lower() in names:
            raise StepError(f"{a.alias!r} is there already")
        names.append(a.alias.lower())
    for k in keys:
        require(frame.df, k, GROUPABLE, "groupBy")
    if ordered or any(a.operation in ("first", "last") for a in aggregations):
        frame = frame.ordered()
        position = frame.position()
    else:
        position = None
    df = frame.df
    medians = [a for a in aggregations if a.operation == "median"]
    for a in medians:
        require(df, a.column, NUMERIC, "median")
    made = [_column(df, a, position).alias(a.alias) for a in aggregations if a.operation != "median"]
    by = [(valid(df, k) if kind_of(df, k) == "float" else named(k)).alias(k) for k in keys]
    at = [F.min(position).alias(ROW)] if ordered else []
    out = df.groupBy(*by).agg(*made, *at) if made or at else df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    out = _with_medians(out, df, by, keys, medians, buckets) if medians else out
    out = out.select(*[named(k) for k in keys], *[named(a.alias) for a in aggregations], *([ROW] if ordered else []))
    return first_seen(out) if ordered else Frame(out)


def first_seen(df: DataFrame) -> Frame:
    """A frame in the order of ROW, a position struct (see `Frame.position`), whose fields become hidden columns."""
    fields = df.schema[ROW].dataType.names
    parts = [F.col(ROW)[f].alias(f"{ROW}_{i}") for i, f in enumerate(fields)]
    # ranks and values of a position are both ascending, nulls first
    return Frame(df.select(*[named(c) for c in df.columns if c != ROW], *parts), tuple(SortRule(f"{ROW}_{i}", nulls="first") for i in range(len(fields))))
