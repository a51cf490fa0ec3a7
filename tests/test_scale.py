"""Steps on skewed keys: buckets, ranks and positions against plain Python, and the plans they come from."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cleanframe.operators.aggregate import Aggregation, group_by
from cleanframe.operators.fill import fill_directional, fill_grouped, fill_linear, fill_median
from cleanframe.operators.rows import drop_duplicates
from cleanframe.plans.frame import Frame, SortRule
from cleanframe.plans.ranges import bucket, group_middles, middle_values, with_buckets
from cleanframe.plans.recipe import Recipe

NAN = float("nan")


def sizes(frame, buckets, lead=None):
    return sorted(r["count"] for r in with_buckets(frame, buckets, lead).groupBy("__bucket").count().collect())


def test_even_buckets_of_like_texts_and_tied_keys(spark):
    texts = spark.range(40_000).select(F.format_string("customer-%012d", "id").alias("k"), F.lit("one").alias("tied"), "id")
    for order in ((SortRule("k"),), (SortRule("k", True),), (SortRule("tied"), SortRule("id")), (SortRule("tied", True), SortRule("k", True))):
        got = sizes(Frame(texts, order), 16)
        assert len(got) == 16 and got[-1] < 2 * 40_000 / 16
    # a partition that holds all rows is divided by the order
    assert sizes(Frame(texts, (SortRule("id"),)), 16, ["tied"])[-1] < 2 * 40_000 / 16


ORDERS = [("a", False, "last"), ("a", True, "first"), ("a", True, "last"), ("b", False, "first"), ("b", True, "last"), ("x", False, "last"), ("x", True, "last"), ("d", True, "first"), ("n", False, "first"), ("z", True, "last")]


@pytest.mark.parametrize("rules", [ORDERS[i : i + 2] for i in range(0, len(ORDERS), 2)])
def test_buckets_and_positions_follow_the_sort(spark, rules):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, -5, 0, 7, 2**62]), rng.choice([None, "", "a", "ab", "b", "é", 'q"\\', "a\u0000"]), rng.choice([None, NAN, -1.5, 0.0, math.inf, -math.inf]), rng.choice([None, "1.50", "-2.25"]), rng.choice([None, "2024-03-31 02:30:00", "1970-01-01 00:00:00.000001"]), rng.choice([None, True, False])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a long, b string, x double, d string, n string, z boolean").withColumns({"d": F.col("d").cast("decimal(10,2)"), "n": F.col("n").cast("timestamp_ntz")})
    frame = Frame(df, (*[SortRule(*r) for r in rules], SortRule("id")))
    want = [r.id for r in df.orderBy(*frame.sort_columns()).collect()]
    assert [r.id for r in df.orderBy(frame.position()).collect()] == want
    placed = {r["id"]: r["__bucket"] for r in with_buckets(frame, 9).collect()}
    order = [placed[i] for i in want]
    assert order == sorted(order) and len(set(order)) > 4


@pytest.mark.parametrize("parts", [None, ["p"]])
@pytest.mark.parametrize("gap", [None, 3])
@pytest.mark.parametrize("down", [False, True])
def test_fills_over_buckets_equal_one_window(spark, parts, gap, down):
    rng = random.Random(8)
    rows = [(i, f"key-{rng.randrange(30):09d}", rng.choice(["hot"] * 6 + ["b", None, "c"]), None if rng.random() < 0.6 else float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, k string, p string, v double")
    rules = [SortRule("k", down)]
    for direction in ("forward", "backward"):
        one, many = (fill_directional(Frame(df, (SortRule("id"),)), "v", direction, rules, gap, parts, buckets=b).df for b in (1, 12))
        assert {r.id: r.v for r in many.collect()} == {r.id: r.v for r in one.collect()}
        naive = {}
        groups = {}
        for r in sorted(sorted(rows, key=lambda r: r[0]), key=lambda r: r[1], reverse=down):
            groups.setdefault(r[2] if parts else 0, []).append(r)
        for g in groups.values():
            for i, r in enumerate(g):
                p, q = i, i
                while p >= 0 and g[p][3] is None:
                    p -= 1
                while q < len(g) and g[q][3] is None:
                    q += 1
                s = p if direction == "forward" else q
                naive[r[0]] = r[3] if r[3] is not None else g[s][3] if 0 <= s < len(g) and (gap is None or q - p - 1 <= gap) else None
        assert {r.id: r.v for r in many.collect()} == naive


def test_linear_fill_in_partitions_over_buckets(spark):
    df = spark.range(500).select((F.col("id") % 3 == 0).alias("p"), "id", F.when(F.col("id") % 7 == 0, F.col("id") * 2.0).alias("v"))
    one, many = (fill_linear(Frame(df), "v", "id", 4, ["p"], buckets=b).df for b in (1, 10))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))


def test_carry_comes_from_a_plain_aggregate(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    filled = fill_directional(Frame(df, (SortRule("id"),)), "v", buckets=4)
    plan = filled.df._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_medians_in_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + ["b", "c", None, NAN and "d"]), rng.choice([0.0] * 4 + [rng.gauss(0, 9), None, NAN])) for _ in range(3000)] + [("alone", 4.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            want.setdefault(g, []).append(v)
    for buckets in (1, 8):
        got = {r.k: (r["__low"], r["__high"]) for r in group_middles(df, [F.col("g")], ["k"], F.col("v"), buckets).collect()}
        assert got == {g: (statistics.median_low(x), statistics.median_high(x)) for g, x in want.items()}
        out = group_by(Frame(df), ["g"], [Aggregation("v", "median", "m"), Aggregation("v", "count", "n"), Aggregation("v", "median", "again")], buckets=buckets).df
        assert out.columns == ["g", "m", "n", "again"]
        assert {r.g: (r.m, r.again) for r in out.collect()} == {g: (statistics.median(want[g]),) * 2 if g in want else (None, None) for g, _ in rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "median" not in plan.lower().replace("__median", "") and "percentile" not in plan.lower()
    only = group_by(Frame(df), ["g"], [Aggregation("v", "median", "m")]).df
    assert {r.g: r.m for r in only.collect()} == {g: statistics.median(want[g]) if g in want else None for g, _ in rows}


def test_a_hot_groups_median_is_spread(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    spread = with_buckets(Frame(df.where("g = 'hot'").select("v"), (SortRule("v"),)), 16).groupBy("__bucket").count()
    assert max(r["count"] for r in spread.collect()) < 2 * 10_000 / 16
    filled = fill_grouped(Frame(df.union(spark.createDataFrame([("hot", None)], "g string, v double"))), "v", ["g"], "median", buckets=16).df
    want = statistics.median(i * 7919 % 20_011 for i in range(0, 20_000, 2))
    assert filled.where("g = 'hot'").exceptAll(df.where("g = 'hot'")).first().v == want


def test_median_of_a_value_that_most_rows_share(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 5 < 3, F.lit(0)).otherwise(F.col("id") - 2500).alias("v"))
    assert middle_values(df, "v", 8) == (0, 0)
    values = sorted(i - 2500 for i in range(5000) if i % 5 >= 3)
    assert middle_values(df.where("v <> 0"), "v", 8) == (statistics.median_low([v for v in values if v]), statistics.median_high([v for v in values if v]))
    assert middle_values(spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("c",)], "v string"), "v", 3) == ("b", "c")
    assert middle_values(df.where("v > 9999"), "v") is None
    more = df.union(spark.createDataFrame([(None,)], "v long"))
    assert fill_median(Frame(more), "v", buckets=8).df.where("v = 0").count() == 3001


@pytest.mark.parametrize("rules", [[SortRule("t")], [SortRule("t", True, "first")], [SortRule("t", True), SortRule("id", True)]])
@pytest.mark.parametrize("keep", ["first", "last"])
def test_duplicates_by_position(spark, rules, keep):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([NAN, 1.0, -0.0, 0.0, None]), rng.choice([None, "x", "xy", "y"])) for i in range(400)]
    rows += rows[:50]  # alike in every column
    df = spark.createDataFrame(rows, "id int, k string, v double, t string")
    frame = Frame(df, tuple(rules))
    out = drop_duplicates(frame, ["k", "v"], keep)
    got = [(r.k, "nan" if r.v is not None and math.isnan(r.v) else r.v, r.t, r.id) for r in out.df.collect()]
    assert len(got) == len({x[:2] for x in got}) == 3 * 4
    ordered = df.orderBy(*frame.sort_columns()).collect()
    best = {}
    for r in ordered if keep == "first" else reversed(ordered):
        best.setdefault((r.k, "nan" if r.v is not None and math.isnan(r.v) else r.v), (r.t, r.id))
    assert {x[:2]: x[2] for x in got} == {k: t for k, (t, _) in best.items()}
    if len(rules) > 1:
        assert {x[:2]: x[3] for x in got} == {k: i for k, (_, i) in best.items()}
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "min_by" not in plan and "max_by" not in plan


def test_order_after_groups_and_pivots(spark):
    df = spark.createDataFrame([(5, "b", "x", 1), (4, "a", "x", 2), (3, None, "x", 3), (2, "b", "y", 4), (1, "c", "y", 5)], "id int, g string, k string, v int")
    frame = Frame(df, (SortRule("id", True),))
    grouped = Recipe().then("groupBy", keys=["g"], aggregations=[{"column": "v", "operation": "sum", "alias": "s"}]).apply(frame)
    assert [r.g for r in grouped.df.orderBy(*grouped.sort_columns()).collect()] == ["b", "a", None, "c"]
    assert grouped.result().columns == ["g", "s"]
    filled = Recipe().then("groupBy", keys=["g", "k"], aggregations=[{"column": "v", "operation": "max", "alias": "m"}, {"column": "id", "operation": "first", "alias": "f"}]).then("fillMissingValues", column="g", replacement={"kind": "directional", "direction": "forward"}).apply(frame)
    assert [(r.g, r.m) for r in filled.df.orderBy("m").collect()] == [("b", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5)]
    wide = Recipe().then("dropColumns", columns=["id"]).then("pivotWider", namesFrom="k", valuesFrom="v", outputs=[{"key": "x", "name": "X"}, {"key": "y", "name": "Y"}])
    kept = wide.apply(Frame(df.withColumn("__cleanframe_row", F.col("id")), (SortRule("__cleanframe_row", True),)))
    assert [r.g for r in kept.df.orderBy(*kept.sort_columns()).collect()] == ["b", "a", None, "c"] and kept.result().columns == ["g", "X", "Y"]
    # sorts keep it for ties, and the rows after them
    tied = Recipe().then("groupBy", keys=["g"], aggregations=[{"column": "v", "operation": "count", "alias": "n"}]).then("sortRows", rules=[{"column": "n"}]).apply(frame)
    assert [r.g for r in tied.df.collect()] == ["a", None, "c", "b"]


@pytest.mark.parametrize("column", ["n", "t"])
@pytest.mark.parametrize("down", [False, True])
def test_times_late_in_the_hour_have_places(spark, column, down):
    # 36 minutes or more in microseconds are no int
    span = "CAST(id * 613 - 40000 AS INT)"
    df = spark.range(200).selectExpr("id", f"TIMESTAMP_NTZ'2024-01-01 00:59:59.5' + make_dt_interval(0, 0, 0, {span}) AS n", f"make_dt_interval(0, 0, 0, {span} + 0.25) AS t", "IF(id % 4 = 0, id, NULL) AS v")
    frame = Frame(df, (SortRule(column, down),))
    placed = [r["__bucket"] for r in with_buckets(frame, 5).orderBy("id", ascending=not down).collect()]
    assert placed == sorted(placed) and len(set(placed)) == 5
    filled = fill_directional(frame, "v", order_by=[SortRule(column, down)], max_gap=3, buckets=5).df
    assert {r.id: r.v for r in filled.collect()} == {i: (i if i % 4 == 0 else None if down and i > 196 else i // 4 * 4 + (4 if down else 0)) for i in range(200)}


def test_medians_look_up_buckets_once_a_value(spark):
    # 20,000 rows of three values: what is put into range buckets are pairs of value and count
    df = spark.range(20_000).select((F.col("id") % 3).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    middles = group_middles(df, [F.col("g")], ["k"], F.col("v"), buckets=4)
    assert sorted(map(tuple, middles.collect())) == [(0, 1.0, 1.0), (1, 1.0, 1.0)]
    plan = middles._jdf.queryExecution().analyzed().toString()
    scanned = plan[plan.rindex("Aggregate [") :].split("], [")[0]  # the keys of the aggregate next to the scan
    assert "__b" not in scanned and "__v" in scanned


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 100])
def test_buckets_by_halving(spark, n):
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("o0", T.LongType())])
    cuts = [f'{{"o0":{10 * i}}}' for i in range(n)]
    got = spark.range(-5, 10 * n + 5).select("id", bucket(F.struct(F.col("id").alias("o0")).cast(kind), cuts, kind).alias("b")).collect()
    assert [r.b for r in got] == [sum(10 * i < r.id for i in range(n)) for r in got]


def test_a_diff_numbers_rows_by_key_and_hot_keys_by_ranges(spark, monkeypatch):
    from cleanframe.plans import diff

    rows = [(k, i * 7 % 5, i * 3 % 11) for k in (None, 1, 2, 3) for i in range(400 if k == 1 else 6)]
    before = spark.createDataFrame(rows, "k int, a int, b int")
    after = before.where("b <> 4 OR k IS NULL").withColumn("a", F.when(F.col("b") == 3, 99).otherwise(F.col("a")))
    plain = diff.step_diff(before, after, ["k"])
    want = sorted(map(str, diff.step_diff(before, after, ["k"], buckets=3).collect()))
    assert "__bucket" not in plain._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(diff, "BUCKET_ROWS", 100)
    ranged = diff.step_diff(before, after, ["k"])
    assert "__bucket" in ranged._jdf.queryExecution().analyzed().toString()
    assert want == sorted(map(str, plain.collect())) == sorted(map(str, ranged.collect()))
    keyless = [sorted(map(str, diff.step_diff(before.drop("k"), after.drop("k"), [], buckets=b).collect())) for b in (None, 2)]
    assert keyless[0] == keyless[1]
