"""Recipes: ordered lists of steps, as JSON and applied to frames."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cleanframe.functions.types import StepError
from cleanframe.operators import columns, encode, example, fill, numeric, reshape, rows, text
from cleanframe.operators.aggregate import Aggregation, group_by
from cleanframe.plans.filters import FilterModel, sort_rows
from cleanframe.plans.frame import Frame, SortRule


def _rules(rules: list[dict]) -> list[SortRule]:
    return [SortRule(r["column"], r.get("direction", "asc") == "desc", r.get("nulls", "last")) for r in rules]


def _fill(frame: Frame, p: dict) -> Frame:
    r = p["replacement"]
    kind, c = r["kind"], p["column"]
    if kind == "mean":
        return fill.fill_mean(frame, c)
    if kind == "median":
        return fill.fill_median(frame, c)
    if kind == "mostFrequent":
        return fill.fill_most_frequent(frame, c)
    if kind == "fallbackColumns":
        return fill.fill_fallback(frame, c, r["columns"])
    if kind == "directional":
        return fill.fill_directional(frame, c, r["direction"], _rules(r.get("orderBy", [])), r.get("maxGap"), r.get("partitionBy"))
    if kind == "linearInterpolation":
        return fill.fill_linear(frame, c, r["coordinate"], r.get("maxGap"), r.get("partitionBy"))
    if kind == "groupedStatistic":
        return fill.fill_grouped(frame, c, r["keys"], r["statistic"])
    if kind == "value":
        return fill.fill_value(frame, c, r["value"])
    raise StepError(f"no replacement {kind!r}")


#: Kind of a step and what it does with its parameters.
STEPS: dict[str, Callable[[Frame, dict], Frame]] = {
    "sortRows": lambda f, p: sort_rows(f, _rules(p["rules"])),
    "filterRows": lambda f, p: FilterModel.from_json(p["filterModel"]).apply(f),
    "dropMissingRows": lambda f, p: rows.drop_missing_rows(f, p.get("columns"), p.get("how", "any")),
    "dropDuplicates": lambda f, p: rows.drop_duplicates(f, p.get("columns"), p.get("keep", "first")),
    "fillMissingValues": _fill,
    "selectColumns": lambda f, p: columns.select_columns(f, p["columns"]),
    "dropColumns": lambda f, p: columns.drop_columns(f, p["columns"]),
    "renameColumn": lambda f, p: columns.rename_column(f, p["column"], p["newName"]),
    "cloneColumn": lambda f, p: columns.clone_column(f, p["column"], p["newName"]),
    "castColumn": lambda f, p: columns.cast_column(f, p["column"], p["dtype"]),
    "formula": lambda f, p: columns.formula(f, p["leftColumn"], p["operator"], p["newColumn"], p.get("rightColumn"), p.get("value")),
    "textLength": lambda f, p: columns.text_length(f, p["column"], p["newColumn"]),
    "findReplace": lambda f, p: text.find_replace(f, p["column"], p["find"], p["replacement"], p.get("regex", False), p.get("newColumn")),
    "stripText": lambda f, p: text.strip_text(f, p["column"], p.get("characters"), p.get("newColumn")),
    "splitText": lambda f, p: text.split_text(f, p["column"], p["delimiter"], p["index"], p["newColumn"]),
    "splitTextColumns": lambda f, p: text.split_text_columns(f, p["column"], p["delimiter"], p["newColumns"]),
    "extractRegexGroup": lambda f, p: text.extract_regex_group(f, p["column"], p["pattern"], p.get("group", 0), p["newColumn"]),
    "capitalizeText": lambda f, p: text.capitalize_text(f, p["column"], p.get("newColumn")),
    "lowerText": lambda f, p: text.lower_text(f, p["column"], p.get("newColumn")),
    "upperText": lambda f, p: text.upper_text(f, p["column"], p.get("newColumn")),
    "oneHotEncode": lambda f, p: encode.one_hot_encode(f, p["columns"], p.get("prefixSeparator", "_"), p.get("dropOriginal", True), p.get("values")),
    "multiLabelBinarize": lambda f, p: encode.multi_label_binarize(f, p["column"], p["delimiter"], p.get("prefix"), p.get("dropOriginal", False), p.get("labels")),
    "minMaxScale": lambda f, p: numeric.min_max_scale(f, p["column"], p.get("newColumn")),
    "roundNumber": lambda f, p: numeric.round_number(f, p["column"], p.get("decimals", 0), p.get("newColumn")),
    "floorNumber": lambda f, p: numeric.floor_number(f, p["column"], p.get("newColumn")),
    "ceilNumber": lambda f, p: numeric.ceil_number(f, p["column"], p.get("newColumn")),
    "formatDatetime": lambda f, p: numeric.format_datetime(f, p["column"], p["format"], p.get("newColumn")),
    "pivotLonger": lambda f, p: reshape.pivot_longer(f, p["columns"], p["labelColumn"], p["valueColumn"]),
    "pivotWider": lambda f, p: reshape.pivot_wider(f, p["namesFrom"], p["valuesFrom"], [(o["key"], o["name"]) for o in p["outputs"]], ordered=True),
    "groupBy": lambda f, p: group_by(f, p["keys"], [Aggregation(a["column"], a["operation"], a["alias"]) for a in p["aggregations"]], ordered=True),
    "byExample": lambda f, p: example.by_example(f, p["program"], p["newColumn"]),
}


@dataclass(frozen=True)
class Step:
    kind: str
    params: dict = field(default_factory=dict)

    def apply(self, frame: Frame) -> Frame:
        if self.kind not in STEPS:
            raise StepError(f"no step {self.kind!r}")
        return STEPS[self.kind](frame, self.params)


@dataclass(frozen=True)
class Custom:
    """A step of one's own: a function of DataFrames, or SQL over `{df}`. It has no JSON."""

    function: Callable[[DataFrame], DataFrame] | None = None
    sql: str | None = None

    def apply(self, frame: Frame) -> Frame:
        out = frame.df.sparkSession.sql(self.sql, df=frame.df) if self.sql else frame.df.transform(self.function)
        if not isinstance(out, DataFrame):
            raise StepError("a custom step gives a DataFrame")
        return frame.with_df(out)


@dataclass(frozen=True)
class Recipe:
    """Steps in order. Applying them composes one plan; Catalyst collapses the projections."""

    steps: tuple = ()

    def apply(self, frame: Frame | DataFrame, upto: int | None = None) -> Frame:
        frame = frame if isinstance(frame, Frame) else Frame(frame)
        for step in self.steps[:upto]:
            frame = step.apply(frame)
        return frame

    def then(self, kind: str, **params) -> Recipe:
        return Recipe((*self.steps, Step(kind, params)))

    def replaced(self, index: int, step: Step) -> Recipe:
        return Recipe((*self.steps[:index], step, *self.steps[index + 1 :]))

    def without(self, index: int) -> Recipe:
        return Recipe((*self.steps[:index], *self.steps[index + 1 :]))

    def to_json(self) -> str:
        return json.dumps([{"kind": s.kind, "params": s.params} for s in self.steps])

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        return cls(tuple(Step(s["kind"], s.get("params", {})) for s in json.loads(text)))
