"""Filling missing values."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.literals import literal
from cleanframe.functions.types import GROUPABLE, NUMERIC, StepError, all_of, kind_of, missing, named, require, rows_only, valid
from cleanframe.functions.types import field as field_of
from cleanframe.operators.numeric import finite
from cleanframe.plans.frame import Frame, SortRule
from cleanframe.plans.ranges import anchors, group_middles, middle_values, sort_number

LONGEST_GAP = 1_000_000


def _filled(frame: Frame, column: str, by: Column) -> Frame:
    kind = field_of(frame.df, column).dataType
    return frame.with_df(frame.df.withColumn(column, F.when(missing(frame.df, column), by.cast(kind)).otherwise(named(column))))


def count_missing(df: DataFrame, column: str) -> DataFrame:
    """One row: how many of the column's values are missing."""
    return df.agg(F.coalesce(F.sum(F.when(missing(df, column), 1).otherwise(0)), F.lit(0)).cast("long").alias("missing"))


def fill_value(frame: Frame, column: str, value: object) -> Frame:
    return _filled(frame, column, literal(value, field_of(frame.df, column).dataType))


def fill_fallback(frame: Frame, column: str, fallbacks: list[str]) -> Frame:
    """The first present value of columns of the same type; where none is present the value stays as it is."""
    if not 1 <= len(fallbacks) <= 64:
        raise StepError("1 to 64 columns to fall back to")
    kind = field_of(frame.df, column).dataType
    for c in fallbacks:
        if field_of(frame.df, c).dataType != kind:
            raise StepError(f"{c!r} is not of the type of {column!r}")
    return frame.with_df(frame.df.withColumn(column, F.coalesce(valid(frame.df, column), *[valid(frame.df, c) for c in fallbacks], named(column))))


def stable_mean(df: DataFrame, column: str, by: list[Column], names: list[str]) -> DataFrame:
    """`names..., __mean`: of doubles, free of overflow; infinite where one sign of infinity is there, else null."""
    v = valid(df, column)
    inf = F.lit(float("inf"))
    first = df.groupBy(*by).agg(F.max(F.abs(finite(v))).alias("__scale"), F.count(F.when(v == inf, 1)).alias("__up"), F.count(F.when(v == -inf, 1)).alias("__down"))
    scaled = df.select(*by, finite(v).alias("__v"))
    if names:
        marked = scaled.join(first, all_of([scaled[f"`{n}`"].eqNullSafe(first[f"`{n}`"]) for n in names])).select(*[scaled[f"`{n}`"] for n in names], "__v", "__scale", "__up", "__down")
    else:
        marked = scaled.crossJoin(F.broadcast(first))
    scale = F.when(F.col("__scale") > 0, F.col("__scale")).otherwise(F.lit(1.0))
    out = marked.groupBy(*names).agg((F.avg(F.col("__v") / scale) * F.first(scale)).alias("__m"), F.first("__up").alias("__up"), F.first("__down").alias("__down"))
    mean = F.when((F.col("__up") > 0) & (F.col("__down") > 0), F.lit(None).cast("double")).when(F.col("__up") > 0, inf).when(F.col("__down") > 0, -inf).otherwise(F.col("__m"))
    return out.select(*names, mean.alias("__mean"))


def fill_mean(frame: Frame, column: str) -> Frame:
    """The mean of a float column. No present value, or infinities of both signs, is an error where one is missing."""
    rows_only(frame.df, "fill with the mean")
    require(frame.df, column, {"float"}, "mean")
    mean = stable_mean(frame.df, column, [], []).first()
    if not count_missing(frame.df, column).first()[0]:
        return frame
    if mean is None or mean["__mean"] is None:
        raise StepError(f"{column!r} has no defined mean")
    return _filled(frame, column, F.lit(mean["__mean"]))


def midpoint(low: object, high: object, kind: str, scale: int = 0) -> object:
    """Half way between two values, exactly in their type; an error where the type can't hold it."""
    if kind == "float":
        return low / 2 + high / 2
    total = Decimal(low) + Decimal(high)
    half = total / 2
    if half != round(half, scale):
        raise StepError(f"the median {half} does not fit the column's type")
    return int(half) if kind == "integer" else half


def fill_median(frame: Frame, column: str, buckets: int | None = None) -> Frame:
    """The exact median of a numeric column, integers of any width included."""
    rows_only(frame.df, "fill with the median")
    kind = require(frame.df, column, NUMERIC, "median")
    if not count_missing(frame.df, column).first()[0]:
        return frame
    middle = middle_values(frame.df, column, buckets)
    if middle is None:
        raise StepError(f"{column!r} has no value")
    data = field_of(frame.df, column).dataType
    value = midpoint(*middle, kind, getattr(data, "scale", 0))
    return _filled(frame, column, literal(value, data) if kind != "float" else F.lit(value))


def fill_most_frequent(frame: Frame, column: str) -> Frame:
    """The most frequent value of a text or boolean column; a tie for it is an error."""
    rows_only(frame.df, "fill with the most frequent value")
    require(frame.df, column, {"string", "boolean"}, "mostFrequent")
    if not count_missing(frame.df, column).first()[0]:
        return frame
    top = frame.df.where(named(column).isNotNull()).groupBy(named(column).alias("v")).count().orderBy(F.desc("count"), "v").limit(2).collect()
    if not top or len(top) == 2 and top[0]["count"] == top[1]["count"]:
        raise StepError(f"{column!r} has no single most frequent value")
    return _filled(frame, column, F.lit(top[0]["v"]))


def _by_order(frame: Frame, rules: list[SortRule] | None) -> Frame:
    frame = frame if rules else frame.ordered()
    if not rules:
        return frame
    ordered = frame.ordered()
    return Frame(ordered.df, (*rules, *[r for r in ordered.order if r.column not in {x.column for x in rules}]))


def _gap(direction_prev: Column, direction_next: Column) -> Column:
    return F.coalesce(direction_next["pos"], F.col("__total") + 1) - F.coalesce(direction_prev["pos"], F.lit(0)) - 1


def fill_directional(frame: Frame, column: str, direction: str = "forward", order_by: list[SortRule] | None = None, max_gap: int | None = None, partition_by: list[str] | None = None, buckets: int | None = None) -> Frame:
    """The last present value before (forward) or the next after (backward), by `order_by` and then the frame's order.

    A run of missing values longer than `max_gap` stays as it is; so does one with no value on that side. Missing
    sort keys are ordered as nulls. With `partition_by` runs end at the partitions.
    """
    rows_only(frame.df, "directional fill")
    if direction not in ("forward", "backward") or max_gap is not None and not 1 <= max_gap <= LONGEST_GAP:
        raise StepError("forward or backward, and a gap of 1 to 1,000,000")
    target = field_of(frame.df, column)
    columns = frame.ordered().df.columns if not order_by else frame.df.columns
    ordered = _by_order(frame, order_by)
    near = anchors(ordered, ~missing(ordered.df, column), named(column), partition_by, buckets, positions=max_gap is not None)
    source = F.col("__prev") if direction == "forward" else F.col("__next")
    may = missing(ordered.df, column) & source.isNotNull()
    if max_gap is not None:
        may = may & (_gap(F.col("__prev"), F.col("__next")) <= max_gap)
    out = near.withColumn(column, F.when(may, source["v"]).otherwise(named(column)).cast(target.dataType)).drop("__pos", "__total", "__prev", "__next")
    return frame.with_df(out.select(*[named(c) for c in columns if c in out.columns]))


def fill_linear(frame: Frame, column: str, coordinate: str, max_gap: int | None = None, partition_by: list[str] | None = None, buckets: int | None = None, strict: bool = True) -> Frame:
    """Straight lines between the present, finite neighbours of a float column along a coordinate.

    The coordinate must be complete, finite and unique (looked at by one job where `strict`). Runs without an anchor
    on both sides, or longer than `max_gap`, stay as they are.
    """
    rows_only(frame.df, "linear interpolation")
    require(frame.df, column, {"float"}, "linearInterpolation")
    kind = require(frame.df, coordinate, NUMERIC | {"date", "datetime"}, "linearInterpolation coordinate")
    df = frame.df
    x = sort_number(df, coordinate)
    if strict:
        by = [named(c) for c in partition_by or []]
        bad = df.agg(F.count(F.when(missing(df, coordinate) | (finite(x).isNull()), 1)).alias("b")).first()["b"]
        twice = df.groupBy(*by, named(coordinate)).count().where("count > 1").limit(1).count()
        if bad or twice:
            raise StepError(f"{coordinate!r} has missing, infinite or repeated values")
    target = field_of(df, column).dataType
    ordered = Frame(df, (SortRule(coordinate), *[r for r in frame.order if r.column != coordinate]))
    v = named(column).cast("double")
    near = anchors(ordered, ~missing(df, column), F.struct(x.alias("x"), v.alias("y")), partition_by, buckets, positions=max_gap is not None)
    a, b = F.col("__prev")["v"], F.col("__next")["v"]
    w = (x - a["x"]) / (b["x"] - a["x"])
    line = a["y"] * (F.lit(1.0) - w) + b["y"] * w
    may = missing(df, column) & F.col("__prev").isNotNull() & F.col("__next").isNotNull() & finite(a["y"]).isNotNull() & finite(b["y"]).isNotNull()
    if max_gap is not None:
        may = may & (_gap(F.col("__prev"), F.col("__next")) <= max_gap)
    out = near.withColumn(column, F.when(may, line.cast(target)).otherwise(named(column))).drop("__pos", "__total", "__prev", "__next")
    return frame.with_df(out.select(*[named(c) for c in df.columns]))


def fill_grouped(frame: Frame, column: str, keys: list[str], statistic: str = "mean", buckets: int | None = None) -> Frame:
    """A statistic of the row's group: mean (float), median (numeric) or mostFrequent (text, boolean).

    Undefined means and tied modes leave values missing. Null and NaN keys make one group. A group's median that does
    not fit its type is an error where a value of the group is missing. Medians are found by rank in all groups at once
    (`group_middles`). Group tables are joined by Spark, which broadcasts small ones and splits skewed ones.
    """
    rows_only(frame.df, "grouped fill")
    df = frame.df
    for k in keys:
        require(df, k, GROUPABLE, "grouped fill keys")
    allowed = {"mean": {"float"}, "median": NUMERIC, "mostFrequent": {"string", "boolean"}}
    if statistic not in allowed:
        raise StepError(f"no statistic {statistic!r}")
    kind = require(df, column, allowed[statistic], statistic)
    data = field_of(df, column).dataType
    names = [f"__k{i}" for i in range(len(keys))]
    by = [valid(df, k).alias(n) for k, n in zip(keys, names, strict=True)]
    v = valid(df, column)
    if statistic == "mean":
        found = stable_mean(df, column, by, names).withColumnRenamed("__mean", "__fill")
    elif statistic == "mostFrequent":
        counts = df.where(v.isNotNull()).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__n"))
        # one aggregate keeps the largest count, its value and the value least by text: they differ on a tie
        best = counts.groupBy(*names).agg(F.max(F.struct("__n", "__v")).alias("__a"), F.min(F.struct((-F.col("__n")).alias("n"), "__v")).alias("__b"))
        found = best.select(*names, F.when(F.col("__a.__v") == F.col("__b.__v"), F.col("__a.__v")).alias("__fill"))
    else:
        ends = group_middles(df, by, names, v, buckets)
        if kind == "float":
            found = ends.select(*names, (F.col("__low") / 2 + F.col("__high") / 2).alias("__fill"))
        else:
            # half way between whole numbers or decimals, as doubles would round it
            wide = f"decimal(38,{getattr(data, 'scale', 0)})"
            low, high = F.col("__low").cast(wide), F.col("__high").cast(wide)
            step = F.lit(10 ** getattr(data, "scale", 0)).cast("decimal(38,0)")
            odd = ((high - low) * step) % 2 != 0
            half = (low + (high - low) / 2).cast(data)
            found = ends.select(*names, F.when(odd, F.lit(True)).otherwise(F.lit(False)).alias("__odd"), F.when(~odd, half).alias("__fill"))
    keyed = df.select("*", *by)
    same = all_of([keyed[n].eqNullSafe(found[n]) for n in names])
    joined = keyed.join(found, same, "left")
    fill = F.col("__fill").cast(data)
    if "__odd" in found.columns:
        fill = F.when(F.col("__odd"), F.raise_error(F.lit(f"a median of {column} does not fit its type")).cast(data)).otherwise(fill)
    value = F.when(missing(df, column) & F.col("__fill").isNotNull() if "__odd" not in found.columns else missing(df, column) & (F.col("__fill").isNotNull() | F.col("__odd")), fill).otherwise(keyed[f"`{column}`"])
    return frame.with_df(joined.select(*[value.alias(c) if c == column else keyed[f"`{c}`"] for c in df.columns]))
