"""Pivots between columns and rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cleanframe.functions.literals import literal
from cleanframe.functions.types import GROUPABLE, StepError, named, require, rows_only, valid
from cleanframe.functions.types import field as field_of
from cleanframe.operators.aggregate import first_seen
from cleanframe.plans.frame import HIDDEN, ROW, Frame, SortRule


def pivot_longer(frame: Frame, columns: list[str], label: str, value: str) -> Frame:
    """A row for each of the columns: its name in `label`, its value (nulls too) in `value`; others are kept.

    Rows are ordered by column, then as before. One pass without a shuffle; fit for streams.
    """
    if not 2 <= len(columns) <= 64 or len(set(columns)) < len(columns):
        raise StepError("2 to 64 different columns pivot")
    types = {field_of(frame.df, c).dataType.simpleString() for c in columns}
    if len(types) > 1:
        raise StepError(f"the columns differ in type: {sorted(types)}")
    kept = [c for c in frame.df.columns if c not in columns]
    if {label.lower(), value.lower()} & {c.lower() for c in kept} or label.lower() == value.lower():
        raise StepError(f"{label!r} or {value!r} is there already")
    cells = F.array(*[F.struct(F.lit(i).alias("__at"), F.lit(c).alias("__label"), named(c).alias("__value")) for i, c in enumerate(columns)])
    out = frame.df.select(*[named(c) for c in kept], F.inline(cells).alias("__cleanframe_at", label, value))
    return Frame(out, (SortRule("__cleanframe_at"), *frame.order) if frame.order and all(r.column in kept for r in frame.order) else ())


def pivot_wider(frame: Frame, names_from: str, values_from: str, outputs: list[tuple[object, str]], ids: list[str] | None = None, strict: bool = True, ordered: bool = False) -> Frame:
    """A column for each declared key. Undeclared or null keys and repeated (ids, key) pairs are errors.

    With `strict` one job looks for those first; without, the error is raised where the result is used. A missing
    combination is null. NaN ids count as null. With `ordered` rows have the order of the first rows of their ids.
    """
    rows_only(frame.df, "pivotWider")
    frame = frame.ordered() if ordered else frame
    if not 2 <= len(outputs) <= 64:
        raise StepError("2 to 64 outputs")
    df = frame.df
    require(df, names_from, GROUPABLE, "pivotWider")
    field_of(df, values_from)
    ids = ids or [c for c in df.columns if c not in (names_from, values_from) and not c.startswith(HIDDEN)]
    taken = {c.lower() for c in ids}
    for _, name in outputs:
        if name.lower() in taken:
            raise StepError(f"{name!r} is there already")
        taken.add(name.lower())
    kind = field_of(df, names_from).dataType
    key = valid(df, names_from)
    keys = [literal(k, kind) for k, _ in outputs]
    declared = F.lit(False)
    for k in keys:
        declared = declared | (key == k)
    bad = F.sum(F.when(F.coalesce(declared, F.lit(False)), 0).otherwise(1))
    most = [F.count(F.when(key == k, 1)) for k in keys]
    by = [valid(df, c).alias(c) for c in ids]
    if strict:
        seen = df.groupBy(*by).agg(bad.alias("b"), F.greatest(*most).alias("m")).agg(F.sum("b"), F.max("m")).first()
        if seen[0]:
            raise StepError(f"{seen[0]} rows have undeclared keys in {names_from!r}")
        if (seen[1] or 0) > 1:
            raise StepError("ids and key repeat")
    cells = [F.first(F.when(key == k, F.struct(named(values_from).alias("v"))), ignorenulls=True)["v"].alias(name) for k, (_, name) in zip(keys, outputs, strict=True)]
    out = df.groupBy(*by).agg(*cells, *([F.min(frame.position()).alias(ROW)] if ordered else []), *([] if strict else [bad.alias("__bad"), F.greatest(*most).alias("__most")]))
    if not strict:
        ok = F.when((F.col("__bad") > 0) | (F.col("__most") > 1), F.raise_error(F.lit("undeclared or repeated keys")).cast("boolean")).otherwise(F.lit(True))
        out = out.where(ok).drop("__bad", "__most")
    return first_seen(out) if ordered else frame.with_df(out)
