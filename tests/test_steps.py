from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.literals import parse
from cleanframe.functions.types import StepError
from cleanframe.operators.aggregate import Aggregation, group_by
from cleanframe.operators.fill import fill_directional, fill_grouped, fill_linear, fill_median
from cleanframe.plans.diff import step_diff
from cleanframe.plans.filters import FilterModel
from cleanframe.plans.frame import Frame, SortRule
from cleanframe.plans.recipe import Recipe

NAN = float("nan")


def values(df, *cols):
    return [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.select(*cols).collect()]


def test_multi_key_sort_keeps_ties_in_order(spark):
    rows = [(0, 2, None), (1, None, 1), (2, 1, 3), (3, 2, 5), (4, None, 9), (5, 2, 4)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    out = Recipe().then("sortRows", rules=[{"column": "a"}, {"column": "b", "direction": "desc", "nulls": "first"}]).apply(Frame(df, (SortRule("id"),)))
    assert [r.id for r in out.df.collect()] == [2, 0, 3, 5, 4, 1]


def test_drop_missing_counts_nan(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (NAN, None), (NAN, 2.0), (3.0, NAN)], "l double, r double")
    assert Recipe().then("dropMissingRows", how="any").apply(df).df.count() == 1
    assert Recipe().then("dropMissingRows", how="all").apply(df).df.count() == 4


@pytest.mark.parametrize(("keep", "expected"), [("first", [1, 3, 5]), ("last", [2, 4, 5]), ("none", [5])])
def test_duplicates(spark, keep, expected):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "c")], "id int, k string")
    up = Recipe().then("dropDuplicates", columns=["k"], keep=keep).apply(Frame(df, (SortRule("id"),)))
    assert sorted(r.id for r in up.df.collect()) == expected
    down = Recipe().then("dropDuplicates", columns=["k"], keep={"first": "last", "last": "first"}.get(keep, keep)).apply(Frame(df, (SortRule("id", True),)))
    assert sorted(r.id for r in down.df.collect()) == expected


def test_predicates_never_match_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, None), (4, 5.0)], "id int, v double")

    def ids(*predicates, **more):
        model = FilterModel.from_json({"filters": [{"column": "v", "predicates": [{"operator": p[0], "value": p[1] if len(p) > 1 else None} for p in predicates]} | more]})
        return [r.id for r in model.filtered(df).orderBy("id").collect()]

    assert ids(("notEquals", "1")) == [4]
    assert ids(("lt", "9")) == [1, 4]
    assert ids(("isNaN",)) == [2]
    assert ids(("isNotNaN",)) == [1, 3, 4]
    assert ids(selectedValues=["5"], includeNulls=True, includeNaN=True) == [2, 3, 4]
    assert ids() == [1, 2, 3, 4]
    with pytest.raises(StepError):
        ids(type="string")


def test_contains_folds_ascii_only(spark):
    df = spark.createDataFrame([("ÄLPHA",), ("älpha",)], "t string")
    model = FilterModel.from_json({"filters": [{"column": "t", "predicates": [{"operator": "contains", "value": "Älp"}]}]})
    assert values(model.filtered(df), "t") == [("ÄLPHA",)]


def test_filters_are_reconciled(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string").schema, spark.createDataFrame([(1.0, "x")], "a double, b string").schema
    model = FilterModel.from_json({"filters": [{"column": "a"}, {"column": "b"}], "sort": [{"column": "a"}]})
    left = model.reconciled(a, b)
    assert [f.column for f in left.filters] == ["b"] and not left.sort


@pytest.mark.parametrize("bad", ["NaN", "1,5", "", "inf"])
def test_float_literals_are_strict(spark, bad):
    kind = spark.createDataFrame([], "v double").schema["v"].dataType
    with pytest.raises(StepError):
        parse(bad, kind)
    assert parse("-Infinity", kind) == -math.inf


def test_text_steps(spark):
    df = spark.createDataFrame([("straße ABC",), ("",), (None,), ("a||b||c",)], "t string")
    r = Recipe().then("upperText", column="t", newColumn="u").then("capitalizeText", column="t", newColumn="c").then("findReplace", column="t", find="", replacement="-", newColumn="e").then("splitTextColumns", column="t", delimiter="||", newColumns=["x", "y", "z"])
    out = values(r.apply(df).df, "u", "c", "e", "x", "y", "z")
    assert out[0] == ("STRASSE ABC", "Straße abc", "-s-t-r-a-ß-e- -A-B-C-", "straße ABC", None, None)
    assert out[1] == ("", "", "-", "", None, None)
    assert out[2] == (None,) * 6
    assert out[3][3:] == ("a", "b", "c")


def test_optional_regex_group(spark):
    df = spark.createDataFrame([("a1",), ("a",), ("zz",), (None,)], "t string")
    out = Recipe().then("extractRegexGroup", column="t", pattern=r"a(\d)?", group=1, newColumn="g").then("extractRegexGroup", column="t", pattern=r"a(\d*)", group=1, newColumn="h").apply(df).df
    assert values(out, "g", "h") == [("1", "1"), (None, ""), (None, None), (None, None)]


def test_encoders(spark):
    df = spark.createDataFrame([("a", "red|β"), (None, ""), ("β", None), ("", "red")], "g string, tags string")
    hot = Recipe().then("oneHotEncode", columns=["g"]).apply(df).df
    assert hot.columns == ["tags", "g_a", "g_β"] and values(hot, "g_a", "g_β") == [(1, 0), (0, 0), (0, 1), (0, 0)]
    many = Recipe().then("multiLabelBinarize", column="tags", delimiter="|").apply(df).df
    assert many.columns == ["g", "tags", "tags_red", "tags_β"] and values(many, "tags_red", "tags_β") == [(1, 1), (0, 0), (0, 0), (1, 0)]
    with pytest.raises(StepError):
        Recipe().then("cloneColumn", column="g", newName="tags_red").then("multiLabelBinarize", column="tags", delimiter="|").apply(df)


def test_numbers(spark):
    inf = math.inf
    df = spark.createDataFrame([(5.0,), (None,), (5.0,), (NAN,)], "v double")
    assert values(Recipe().then("minMaxScale", column="v").apply(df).df, "v") == [(0.0,), (None,), (0.0,), (None,)]
    df = spark.createDataFrame([(2.5,), (3.5,), (-inf,), (inf,), (-1.2,)], "v double")
    out = Recipe().then("roundNumber", column="v", newColumn="r").then("floorNumber", column="v", newColumn="f").then("ceilNumber", column="v", newColumn="c").apply(df).df
    assert values(out, "r", "f", "c") == [(2.0, 2.0, 3.0), (4.0, 3.0, 4.0), (-inf, -inf, -inf), (inf, inf, inf), (-1.0, -2.0, -1.0)]


def test_formula_follows_ieee(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (-7, 3), (None, 2)], "a int, b int")
    out = Recipe().then("formula", leftColumn="a", operator="divide", rightColumn="b", newColumn="d").then("formula", leftColumn="a", operator="modulo", rightColumn="b", newColumn="m").apply(df).df
    assert values(out, "d", "m") == [(math.inf, None), (None, None), (-7 / 3, -1), (None, None)]
    assert math.isnan(out.collect()[1]["d"])


def test_wide_sums_and_empty_groups(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([("a", big, None), ("a", big, None), ("b", None, 1.5)], "g string, v long, w double")
    out = group_by(Frame(df), ["g"], [Aggregation("v", "sum", "s"), Aggregation("w", "count", "n"), Aggregation("w", "sum", "t")]).df.orderBy("g")
    assert [(int(r.s), r.n, r.t) for r in out.collect()] == [(2 * big, 0, 0.0), (0, 1, 1.5)]


def test_first_seen_order(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "id int, g string")
    out = group_by(Frame(df, (SortRule("id"),)), ["g"], [Aggregation("id", "count", "n")], ordered=True).df
    assert values(out, "g", "n") == [("b", 2), ("a", 1), (None, 1)]


def test_pivots(spark):
    df = spark.createDataFrame([("b", "x", 3), ("a", "x", 1), ("b", "y", 4)], "g string, k string, v long")
    wide = Recipe().then("pivotWider", namesFrom="k", valuesFrom="v", outputs=[{"key": "x", "name": "X"}, {"key": "y", "name": "Y"}])
    assert sorted(values(wide.apply(df).df, "g", "X", "Y")) == [("a", 1, None), ("b", 3, 4)]
    with pytest.raises(StepError):
        wide.apply(df.union(df))
    with pytest.raises(StepError):
        Recipe().then("pivotWider", namesFrom="k", valuesFrom="v", outputs=[{"key": "x", "name": "X"}, {"key": "z", "name": "Z"}]).apply(df)
    long = Recipe().then("pivotLonger", columns=["X", "Y"], labelColumn="k", valueColumn="v").apply(wide.apply(df)).df
    assert sorted(values(long, "g", "k", "v"), key=str) == [("a", "X", 1), ("a", "Y", None), ("b", "X", 3), ("b", "Y", 4)]


def _naive(rows, forward, most):
    """Runs of missing values in a sorted list of (id, key, value)."""
    out, n = [], len(rows)
    for i, (row, _, v) in enumerate(rows):
        if v is None:
            p, q = i, i
            while p >= 0 and rows[p][2] is None:
                p -= 1
            while q < n and rows[q][2] is None:
                q += 1
            source = p if forward else q
            if 0 <= source < n and q - p - 1 <= most:
                v = rows[source][2]
        out.append((row, v))
    return out


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("buckets", [1, 7])
def test_directional_fill_in_buckets(spark, forward, buckets):
    import random

    random.seed(buckets)
    rows = [(i, random.randrange(40), None if random.random() < 0.6 else i) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k int, v int")
    out = fill_directional(Frame(df, (SortRule("id"),)), "v", "forward" if forward else "backward", [SortRule("k")], 3, buckets=buckets)
    got = {r.id: r.v for r in out.df.collect()}
    assert got == dict(_naive(sorted(rows, key=lambda r: (r[1], r[0])), forward, 3))


def test_linear_fill(spark):
    df = spark.createDataFrame([(10.0, 10.0), (0.0, 0.0), (4.0, None), (1.0, NAN), (7.0, None)], "x double, v double")
    for buckets in (1, 3):
        out = fill_linear(Frame(df), "v", "x", buckets=buckets).df
        assert sorted(values(out, "x", "v")) == [(0.0, 0.0), (1.0, 1.0), (4.0, 4.0), (7.0, 7.0), (10.0, 10.0)]
    with pytest.raises(StepError):
        fill_linear(Frame(df.union(df)), "v", "x")


def test_exact_medians(spark):
    base = 2**57
    df = spark.createDataFrame([(base + 2 * i,) for i in range(401)] + [(None,)], "v long")
    assert fill_median(Frame(df), "v", buckets=8).df.where(F.col("v") == base + 400).count() == 2
    with pytest.raises(StepError):
        fill_median(Frame(spark.createDataFrame([(1,), (2,), (None,)], "v long")), "v")


def test_grouped_fills(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "x"), ("a", None, None), (None, 5.0, "y"), (None, NAN, None), ("b", math.inf, "p"), ("b", -math.inf, "q"), ("b", None, None)], "k string, v double, t string")
    mean = fill_grouped(Frame(df), "v", ["k"], "mean").df
    got = sorted(values(mean.where("t is null"), "k", "v"), key=str)
    assert got == [("a", 2.0), ("b", None), (None, 5.0)]
    mode = fill_grouped(Frame(df), "t", ["k"], "mostFrequent").df
    assert mode.where("t is null").count() == 1
    ints = spark.createDataFrame([("a", 1), ("a", 4), ("a", None), ("b", 1), ("b", 2)], "k string, v long")
    with pytest.raises(Exception, match="does not fit"):
        fill_grouped(Frame(ints), "v", ["k"], "median").df.collect()
    assert fill_grouped(Frame(ints.where("k = 'b'").union(spark.createDataFrame([("b", 3), ("b", None)], "k string, v long"))), "v", ["k"], "median").df.where("v = 2").count() == 2


def test_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "n")], "id int, v string")
    assert sorted(values(step_diff(a, b, ["id"]), "id", "change", "old", "new")) == [(2, "changed", "y", "z"), (3, "removed", None, None), (4, "added", None, None)]


def test_recipes_edit_and_replay(spark):
    df = spark.createDataFrame([(1, "A "), (2, "b")], "id int, t string")
    r = Recipe().then("stripText", column="t").then("lowerText", column="t")
    assert values(r.apply(df).df, "t") == [("a",), ("b",)]
    assert values(r.without(1).apply(df).df, "t") == [("A",), ("b",)]
    assert values(r.apply(df, upto=0).df, "t") == [("A ",), ("b",)]
    assert Recipe.from_json(r.to_json()) == r
    with pytest.raises(StepError):
        Recipe().then("renameColumn", column="t", newName="ID").apply(df)


def test_profile_canonical_values(spark):
    from cleanframe.operators import profile

    df = spark.createDataFrame([({"b": 1, "a": 2}, 0.0), ({"a": 2, "b": 1}, -0.0), (None, NAN)], "m map<string,int>, v double")
    counts = {r["column"]: (r["nulls"], r["nans"], r["distinct"]) for r in profile.base_counts(df).collect()}
    assert counts == {"m": (1, 0, 1), "v": (0, 1, 1)}
    stats = profile.dataset_stats(df).first()
    assert (stats.rows, stats.missing_cells, stats.rows_with_missing, stats.duplicate_rows) == (3, 2, 1, 1)


def test_row_local_steps_run_on_streams(spark, tmp_path):
    from cleanframe.streaming.stateless import apply_to_stream

    df = spark.createDataFrame([(1, " A "), (2, None)], "id int, t string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    r = Recipe().then("stripText", column="t").then("fillMissingValues", column="t", replacement={"kind": "value", "value": "-"})
    q = apply_to_stream(r, stream).writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(values(spark.table("cleaned"), "id", "t")) == [(1, "A"), (2, "-")]
    for kind, p in (("dropDuplicates", {}), ("minMaxScale", {"column": "id"})):
        with pytest.raises(StepError):
            apply_to_stream(Recipe().then(kind, **p), stream)


def test_blank_delimited_file(spark, tmp_path):
    from cleanframe.sources.files import read_delimited

    (tmp_path / "blank.csv").write_text("﻿ \n\n")
    assert read_delimited(spark, str(tmp_path / "blank.csv")).columns == []


#: Texts that are literals of their type, and texts that are none.
ACCEPTED = [
    ("integer", "+1000"), ("float", "-1.25e3"), ("float", "Infinity"), ("decimal", ".1250e+2"), ("boolean", " TRUE "), ("date", "0001-01-01"), ("date", "2024-01-31"),
    ("datetime", "2024-01-31T23:59:58.123456+02:30"), ("duration", "-1.25"), ("duration", "86399999999999.999999"), ("duration", "-86399999913600"), ("duration", "1 day, 02:03:04.5"),
]
REJECTED = [
    ("integer", "1_000"), ("integer", " 1000"), ("float", "1_000"), ("float", "NaN"), ("float", "1e999999"), ("decimal", "Infinity"), ("boolean", "yes"), ("date", "20240131"), ("date", "0000-01-01"),
    ("date", "2024-02-30"), ("datetime", "20240131T235958"), ("datetime", "23:59:58"), ("datetime", "0000-01-01T00:00:00"), ("datetime", "2024-01-31T24:00:00"), ("datetime", "2024-01-31T00:00:00+24:00"),
    ("duration", "25:00:00"), ("duration", "00:60:00"), ("duration", "86400000000000"), ("duration", "-86399999913600.000001"), ("duration", "1000000000 days, 00:00:00"), ("duration", "0.0000001"), ("duration", "1e3"),
]
KIND = {"integer": T.LongType(), "float": T.DoubleType(), "decimal": T.DecimalType(20, 4), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampType(), "duration": T.DayTimeIntervalType()}


def test_literal_forms():
    got = [parse(v, KIND[k]) for k, v in ACCEPTED]
    assert got[:5] == [1000, -1250.0, math.inf, Decimal("12.5"), True]
    assert got[8] == dt.timedelta(seconds=-1.25) and got[9] == dt.timedelta.max and got[10] == dt.timedelta.min and got[11] == dt.timedelta(days=1, hours=2, minutes=3, seconds=4.5)
    for kind, value in [*REJECTED, ("decimal", "1_000"), ("integer", True), ("float", False)]:
        with pytest.raises(StepError):
            parse(value, KIND[kind])


def test_fills_take_no_shrinking_frame(spark):
    df = spark.range(100).selectExpr("id", "if(id % 7 = 0, double(id), null) AS v")
    for direction in ("forward", "backward"):
        out = fill_directional(Frame(df, (SortRule("id"),)), "v", direction, buckets=3).df
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower().replace("unboundedpreceding$(), unboundedfollowing", "")
        want = {i: float(i // 7 * 7 if direction == "forward" else -(-i // 7) * 7) for i in range(98)}
        assert {r.id: r.v for r in out.where("id < 98").collect()} == want


def test_medians_of_many_values(spark, monkeypatch):
    from cleanframe.operators import profile

    df = spark.range(999).selectExpr("double(id * 7 % 999) AS v", "id AS i")
    one = profile.numeric_summary(df, ["v", "i"]).collect()
    monkeypatch.setattr(profile, "MEDIAN_VALUES", 10)
    assert profile.numeric_summary(df, ["v", "i"]).collect() == one and [r.median for r in one] == [499.0, 499.0]
