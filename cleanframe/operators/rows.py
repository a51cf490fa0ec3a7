"""Steps on rows: drop missing, drop duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.types import StepError, all_of, any_of, missing, named, rows_only
from cleanframe.functions.types import field as field_of
from cleanframe.plans.frame import Frame


def drop_missing_rows(frame: Frame, columns: list[str] | None = None, how: str = "any") -> Frame:
    """Drops rows where any (or all) of the columns are missing; no column: all of them count."""
    df = frame.df
    gone = [missing(df, c) for c in columns or frame.result().columns]
    return frame.with_df(df.filter(~(any_of(gone) if how == "any" else all_of(gone))))


def drop_duplicates(frame: Frame, columns: list[str] | None = None, keep: str = "first") -> Frame:
    """Keeps the first or last of equal rows in the frame's order, or (`none`) only rows without an equal.

    Nulls equal nulls, and NaN equals NaN. Only keys and positions are aggregated, with map-side partial results; the rows
    themselves move once, to meet the position that stays. Orders of any direction are positions (`Frame.position`).
    Where equal rows tie in an order of one's own, one of them stays: that of the least hash, by all its columns.
    """
    rows_only(frame.df, "dropDuplicates")
    names = columns or frame.result().columns
    if keep == "none":
        counts = frame.df.groupBy(*[named(c) for c in names]).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
        same = all_of([frame.df[f"`{c}`"].eqNullSafe(counts[f"`{c}`"]) for c in names])
        return frame.with_df(frame.df.join(counts, same, "left_semi"))
    if keep not in ("first", "last"):
        raise StepError(f"keep is first, last or none, not {keep!r}")
    ordered = frame.ordered()
    if columns is None and not frame.order:
        return frame.with_df(frame.df.dropDuplicates())
    df = ordered.df
    total = not frame.order  # numbered by us: no two rows tie
    position = ordered.position()
    if not total:
        position = F.struct(position.alias("p"), F.xxhash64(*[_hashable(df, c) for c in df.columns]).alias("h"))
    marked = df.withColumn("__at", position)
    pick = F.min if keep == "first" else F.max
    stay = marked.groupBy(*[named(c).alias(f"__k{i}") for i, c in enumerate(names)]).agg(pick("__at").alias("__stay"))
    # NaN equals NaN in a join as well, and the position alone tells most rows apart
    out = marked.join(stay, all_of([*[named(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)], F.col("__at") == F.col("__stay")]), "left_semi")
    if not total:
        # rows alike in every column, order included, are still all there; they share a task by now
        out = _once(out, df.columns)
    return ordered.with_df(out.select(*[named(c) for c in df.columns]))


def _hashable(df: DataFrame, c: str) -> Column:
    return F.to_json(named(c)) if "map<" in field_of(df, c).dataType.simpleString() else named(c)


def _once(df: DataFrame, columns: list[str]) -> DataFrame:
    """One of the rows that are alike in all columns; maps are alike by their text."""
    maps = [c for c in columns if "map<" in field_of(df, c).dataType.simpleString()]
    if not maps:
        return df.groupBy(*[named(c) for c in columns]).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    keys = [_hashable(df, c).alias(f"__k{i}") for i, c in enumerate(columns)]
    row = F.struct(*[named(c) for c in columns])
    return df.groupBy(*keys).agg(F.first(row).alias("__row")).select("__row.*")
