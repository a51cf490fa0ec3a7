"""A table and its row order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from cleanframe.functions.types import kind_of, missing, named
from cleanframe.functions.types import field as field_of

#: Columns that hold the order of rows, and are no columns of the table, begin so.
HIDDEN = "__cleanframe"
ROW = f"{HIDDEN}_row"


@dataclass(frozen=True)
class SortRule:
    """One sort key. NaN sorts as the largest value."""

    column: str
    descending: bool = False
    nulls: str = "last"

    def expression(self) -> Column:
        c = named(self.column)
        if self.descending:
            return c.desc_nulls_first() if self.nulls == "first" else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls == "first" else c.asc_nulls_last()


def _turned(c: Column, kind: str) -> Column:
    """A value that rises where `c` falls."""
    if kind == "long":
        return F.bitwise_not(c)
    if kind == "string":
        # a text comes after those that go on from it: the sign at its end is larger than all digits
        return F.concat(F.translate(F.hex(c.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    return -c


def order_fields(df: DataFrame, rule: SortRule) -> list[Column]:
    """Columns whose ascending order is that of the rule: a rank of nulls, NaN and other values, and the value itself as
    a long, double, decimal or text. A column without nulls and NaN needs no rank."""
    kind, c = kind_of(df, rule.column), named(rule.column)
    data = field_of(df, rule.column).dataType
    if kind in ("decimal", "integer") and isinstance(data, T.DecimalType):
        simple, v = "decimal", c
    elif kind == "float":
        simple, v = "double", F.when(~F.isnan(c), c.cast("double"))
    elif kind in ("integer", "boolean", "date", "datetime", "duration"):
        simple, v = "long", whole_number(c, kind, data)
    else:
        simple, v = "string", c.cast("string")
    v = _turned(v, simple) if rule.descending else v
    if not field_of(df, rule.column).nullable and kind != "float":
        return [v]
    rank = F.when(c.isNull(), 0 if rule.nulls == "first" else 4).when(missing(df, rule.column), 1 if rule.descending else 3).otherwise(2)
    return [rank, v]


def whole_number(c: Column, kind: str, data: T.DataType) -> Column:
    """Whole numbers, booleans, dates, times and durations as a long, times and durations in microseconds."""
    if kind == "boolean":
        return c.cast("int").cast("long")
    if kind == "date":
        return F.unix_date(c).cast("long")
    # parts are ints, whose products would leave their range: 59 minutes are 3.54e9 microseconds
    part = lambda unit: F.extract(F.lit(unit), c).cast("long")
    second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    if kind == "datetime" and not isinstance(data, T.TimestampType):
        # without a zone: by its calendar, which never jumps back
        return F.unix_date(F.to_date(c)).cast("long") * 86_400_000_000 + part("HOUR") * 3_600_000_000 + part("MINUTE") * 60_000_000 + second
    if kind == "datetime":
        return F.unix_micros(c)
    if kind == "duration":
        return ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000_000 + second
    return c.cast("long")


@dataclass(frozen=True)
class Frame:
    """A DataFrame whose rows have the order of `order` (none: not known yet).

    Steps that depend on order ask for `ordered()`. Without sort rules it numbers the rows by
    `monotonically_increasing_id`, as late as that, so that earlier filters still reach the scan; the number
    is stable for one plan over one scan. Name unique columns, or `by_file_position`, where that is too weak.
    """

    df: DataFrame
    order: tuple[SortRule, ...] = ()

    def with_df(self, df: DataFrame) -> Frame:
        order = tuple(r for r in self.order if r.column in df.columns)
        return Frame(df, order if len(order) == len(self.order) else ())

    def ordered(self) -> Frame:
        """This frame with an order. Hidden order columns begin with HIDDEN, and `result()` leaves them out."""
        return self if self.order else Frame(self.df.withColumn(ROW, F.monotonically_increasing_id()), (SortRule(ROW),))

    def sort_columns(self) -> list[Column]:
        return [r.expression() for r in self.order]

    def position(self, lead: list[str] | None = None) -> Column:
        """A struct that orders as the rows do, whatever the rules' directions, for min_by, max_by and comparisons.

        Columns of `lead` come before the rules, ascending.
        """
        rules = (*[SortRule(c, nulls="first") for c in lead or []], *self.order)
        fields = [f for r in rules for f in order_fields(self.df, r)]
        return F.struct(*[f.alias(f"o{i}") for i, f in enumerate(fields)])

    def sorted_by(self, rules: list[SortRule]) -> Frame:
        """The order after a sort: the rules, with the previous order for ties."""
        names = {r.column for r in rules}
        return replace(self, order=(*rules, *[r for r in self.order if r.column not in names]))

    def result(self) -> DataFrame:
        return self.df.drop(*[c for c in self.df.columns if c.startswith(HIDDEN)])


def by_file_position(df: DataFrame) -> Frame:
    """Rows of a file source in file order: path, then row in the file (Parquet)."""
    at = df.select("*", F.col("_metadata.file_path").alias("__cleanframe_file"), F.col("_metadata.row_index").alias(ROW))
    return Frame(at, (SortRule("__cleanframe_file"), SortRule(ROW)))
