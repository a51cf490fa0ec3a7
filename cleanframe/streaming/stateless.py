"""Recipes on streams: steps that look at one row at a time run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cleanframe.functions.types import StepError
from cleanframe.plans.recipe import Recipe

#: Kinds whose steps are projections or filters, whatever their parameters.
ROW_LOCAL = {
    "filterRows", "dropMissingRows", "selectColumns", "dropColumns", "renameColumn", "cloneColumn", "castColumn", "formula", "textLength", "findReplace", "stripText", "splitText", "splitTextColumns",
    "extractRegexGroup", "capitalizeText", "lowerText", "upperText", "roundNumber", "floorNumber", "ceilNumber", "formatDatetime", "pivotLonger", "byExample",
}


def is_row_local(step) -> bool:
    kind, p = getattr(step, "kind", None), getattr(step, "params", {})
    if kind == "fillMissingValues":
        return p["replacement"]["kind"] in ("value", "fallbackColumns")
    if kind == "oneHotEncode":
        return bool(p.get("values"))
    if kind == "multiLabelBinarize":
        return bool(p.get("labels"))
    if kind == "filterRows":
        return not p["filterModel"].get("sort")
    return kind in ROW_LOCAL


def apply_to_stream(recipe: Recipe, stream: DataFrame) -> DataFrame:
    """The recipe on a streaming DataFrame; a step that needs the whole table is refused before the query starts."""
    for step in recipe.steps:
        if not is_row_local(step):
            raise StepError(f"{getattr(step, 'kind', 'a custom step')} needs the whole table and can't run on a stream")
    return recipe.apply(stream).df
