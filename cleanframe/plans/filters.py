"""The view's filter model: predicates, value lists, sorts, pages."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.literals import literal
from cleanframe.functions.types import ORDERED, StepError, all_of, any_of, kind_of, missing, named
from cleanframe.functions.types import field as field_of
from cleanframe.plans.frame import Frame, SortRule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COMPARE = {"equals": "__eq__", "notEquals": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
_TEXT = ("contains", "startsWith", "endsWith")


def ascii_folded(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


@dataclass(frozen=True)
class Predicate:
    operator: str
    value: object = None
    second: object = None

    def column(self, df: DataFrame, name: str) -> Column:
        """Never true for missing values, but for isNull and isNaN."""
        c, kind, op = named(name), kind_of(df, name), self.operator
        if op == "isNull":
            return c.isNull()
        if op == "isNotNull":
            return c.isNotNull()
        if op in ("isNaN", "isNotNaN"):
            if kind != "float":
                raise StepError(f"{op} takes float columns; {name!r} is {kind}")
            return F.coalesce(F.isnan(c), F.lit(False)) if op == "isNaN" else ~F.coalesce(F.isnan(c), F.lit(False))
        here = ~missing(df, name)
        if op in _TEXT:
            if kind != "string":
                raise StepError(f"{op} takes text columns; {name!r} is {kind}")
            text = str(self.value)
            test = ascii_folded(c).contains(F.lit(text.translate(str.maketrans(_UPPER, _LOWER)))) if op == "contains" else c.startswith(text) if op == "startsWith" else c.endswith(text)
            return here & test
        data = field_of(df, name).dataType
        if op == "between":
            if kind not in ORDERED:
                raise StepError(f"between takes ordered columns; {name!r} is {kind}")
            return here & c.between(literal(self.value, data), literal(self.second, data))
        if op not in _COMPARE:
            raise StepError(f"no predicate {op!r}")
        if op not in ("equals", "notEquals") and kind not in ORDERED:
            raise StepError(f"{op} takes ordered columns; {name!r} is {kind}")
        return here & getattr(c, _COMPARE[op])(literal(self.value, data))


@dataclass(frozen=True)
class ColumnFilter:
    """Predicates on a column, joined by `logic`, and a list of values to keep (inactive where it names none)."""

    column: str
    predicates: tuple[Predicate, ...] = ()
    logic: str = "and"
    values: tuple = ()
    include_nulls: bool = False
    include_nan: bool = False
    type: str | None = None

    def condition(self, df: DataFrame) -> Column | None:
        kind = kind_of(df, self.column)
        if self.type and self.type != kind:
            raise StepError(f"the filter is for {self.type}; {self.column!r} is {kind}")
        c, data = named(self.column), field_of(df, self.column).dataType
        parts = [p.column(df, self.column) for p in self.predicates]
        found = [(all_of if self.logic == "and" else any_of)(parts)] if parts else []
        chosen = []
        if self.values:
            chosen.append(~missing(df, self.column) & any_of([c == literal(v, data) for v in self.values]))
        if self.include_nulls:
            chosen.append(c.isNull())
        if self.include_nan and kind == "float":
            chosen.append(F.coalesce(F.isnan(c), F.lit(False)))
        if chosen:
            found.append(any_of(chosen))
        return all_of(found) if found else None


@dataclass(frozen=True)
class FilterModel:
    filters: tuple[ColumnFilter, ...] = ()
    logic: str = "and"
    sort: tuple[SortRule, ...] = field(default=())

    def condition(self, df: DataFrame) -> Column | None:
        found = [c for c in (f.condition(df) for f in self.filters) if c is not None]
        return (all_of if self.logic == "and" else any_of)(found) if found else None

    def filtered(self, df: DataFrame) -> DataFrame:
        condition = self.condition(df)
        return df if condition is None else df.filter(F.coalesce(condition, F.lit(False)))

    def apply(self, frame: Frame) -> Frame:
        out = frame.with_df(self.filtered(frame.df))
        return sort_rows(out, list(self.sort)) if self.sort else out

    def reconciled(self, before: T.StructType, after: T.StructType) -> FilterModel:
        """The rules whose column is still there with the same type."""
        types = {f.name: f.dataType for f in before.fields}
        names = [f.name for f in after.fields]
        same = {f.name for f in after.fields if types.get(f.name) == f.dataType and names.count(f.name) == 1}
        return replace(self, filters=tuple(f for f in self.filters if f.column in same), sort=tuple(r for r in self.sort if r.column in same))

    @classmethod
    def from_json(cls, x: dict) -> FilterModel:
        filters = tuple(ColumnFilter(f["column"], tuple(Predicate(p["operator"], p.get("value"), p.get("secondValue")) for p in f.get("predicates", ())), f.get("logic", "and"), tuple(f.get("selectedValues", ())), f.get("includeNulls", False), f.get("includeNaN", False), f.get("type")) for f in x.get("filters", ()))
        sort = tuple(SortRule(r["column"], r.get("direction", "asc") == "desc", r.get("nulls", "last")) for r in x.get("sort", ()))
        return cls(filters, x.get("logic", "and"), sort)


def sort_rows(frame: Frame, rules: list[SortRule]) -> Frame:
    """A stable sort: ties keep the previous order. Streams can't be sorted."""
    if not rules:
        raise StepError("a sort needs a rule")
    for r in rules:
        kind = kind_of(frame.df, r.column)
        if kind in ("list", "struct", "unknown"):
            raise StepError(f"{r.column!r} is {kind} and has no order")
    out = frame.sorted_by(rules)
    return Frame(out.df.orderBy(*out.sort_columns()), out.order)


def page(frame: Frame, offset: int, limit: int, columns: list[str] | None = None) -> DataFrame:
    """Rows offset .. offset + limit in the frame's order, and only the named columns."""
    ordered = frame.ordered()
    shown = [c for c in columns or frame.result().columns]
    rows = ordered.df.select(*{*map(named_key, shown), *(named_key(r.column) for r in ordered.order)})
    return rows.orderBy(*ordered.sort_columns()).offset(offset).limit(limit).select(*[named(c) for c in shown])


def named_key(name: str) -> str:
    return f"`{name}`"
