"""Categorical encoders: 0/1 columns for values and for labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanframe.functions.types import StepError, kind_of, named, rows_only, valid
from cleanframe.functions.types import field as field_of
from cleanframe.plans.frame import Frame

#: Most columns that an encoder makes: more is an error, never a cut.
MOST = 2048


def _shown(df: DataFrame, column: str) -> Column:
    """A value's text as it stands in a column name: booleans as True and False."""
    c = valid(df, column)
    return F.when(c, "True").when(~c, "False") if kind_of(df, column) == "boolean" else c.cast("string")


def _labels(values: DataFrame, what: str) -> list[str]:
    """Distinct labels, read up to one more than allowed."""
    found = [r[0] for r in values.distinct().limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise StepError(f"{what} has more than {MOST} values")
    return found


def _added(frame: Frame, made: dict[str, Column], dropped: list[str]) -> Frame:
    kept = [c for c in frame.df.columns if c not in dropped]
    taken = {c.lower() for c in kept}
    for name in made:
        if name.lower() in taken:
            raise StepError(f"{name!r} is there already")
        taken.add(name.lower())
    return frame.with_df(frame.df.select(*[named(c) for c in kept], *[made[n].cast("tinyint").alias(n) for n in sorted(made)]))


def one_hot_encode(frame: Frame, columns: list[str], separator: str = "_", drop_original: bool = True, values: dict[str, list[str]] | None = None) -> Frame:
    """One column for each present, non-blank value; rows without the value (nulls too) have 0.

    One pass finds the values unless `values` declares them, which also makes the step fit for streams.
    """
    made: dict[str, Column] = {}
    for column in columns:
        field_of(frame.df, column)
        shown = _shown(frame.df, column)
        if values is None:
            rows_only(frame.df, "oneHotEncode without declared values")
            texts = _labels(frame.df.select(shown.alias("v")).where(F.trim("v") != ""), column)
        else:
            texts = values[column]
        for text in texts:
            name = f"{column}{separator}{text}"
            if name in made:
                raise StepError(f"two values make the column {name!r}")
            made[name] = F.when(shown == text, 1).otherwise(0)
    return _added(frame, made, columns if drop_original else [])


def multi_label_binarize(frame: Frame, column: str, delimiter: str, prefix: str | None = None, drop_original: bool = False, labels: list[str] | None = None) -> Frame:
    """One column for each label of a delimited text; `labels` declares them, else one pass finds them."""
    field_of(frame.df, column)
    if not delimiter:
        raise StepError("labels need a delimiter")
    parts = F.split(named(column).cast("string"), r"\Q" + delimiter + r"\E", -1)
    if labels is None:
        rows_only(frame.df, "multiLabelBinarize without declared labels")
        labels = _labels(frame.df.select(F.explode(parts).alias("v")).where(F.trim("v") != ""), column)
    prefix = f"{column}_" if prefix is None else prefix
    made = {prefix + v: F.when(F.array_contains(parts, v), 1).otherwise(0) for v in labels}
    return _added(frame, made, [column] if drop_original else [])
