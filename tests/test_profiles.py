"""Profiles of all columns at once, samples by hash, duplicates behind digests, and diffs of repeated keys."""

from __future__ import annotations

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cleanframe.operators import profile
from cleanframe.plans.diff import diff_counts, step_diff

NAN, INF = float("nan"), float("inf")


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([NAN, None, 0.0, -0.0, INF, 1.5, rng.gauss(0, 1)]), rng.choice([None, "", "a", "b" * 100, "b" * 100 + "c"]), rng.choice([True, None]), rng.choice([None, [1], [1, 2]])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, k int, x double, t string, b boolean, l array<int>").withColumns({"d": F.expr("date_add(date'2024-01-01', k)"), "m": F.col("k").cast("decimal(9,2)"), "ts": F.timestamp_micros(F.col("i") % 7), "bin": F.col("t").cast("binary")})
    path = str(tmp_path_factory.mktemp("mixed") / "t")
    df.write.parquet(path)
    return spark.read.parquet(path), rows


def test_counts_of_all_columns_in_one_scan(spark, mixed):
    df, rows = mixed
    out = profile.base_counts(df)
    assert scans(out) == 1 and "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["column"]: (r["total"], r["nulls"], r["nans"], r["distinct"]) for r in out.collect()}
    want = {c: (500, df.where(F.col(c).isNull()).count(), 0, df.select(c).where(F.col(c).isNotNull()).distinct().count()) for c in df.columns if c != "x"}
    xs = [r[2] for r in rows]
    want["x"] = (500, sum(x is None for x in xs), sum(x is not None and math.isnan(x) for x in xs), len({x for x in xs if x is not None and not math.isnan(x)}))
    assert got == want and [r["column"] for r in out.collect()] == df.columns
    assert {tuple(r)[1:] for r in profile.base_counts(df.where("i < 0")).collect()} == {(0, 0, 0, 0)}


def naive_bins(xs, bins=20):
    xs = [x for x in xs if x is not None and math.isfinite(x)]
    if not xs:
        return []
    low, high = min(xs), max(xs)
    n = 1 if low == high else min(bins, len(set(xs)))
    edges = [low * ((n - i) / n) + high * (i / n) for i in range(n)] + [high]
    return [(i, edges[i], edges[i + 1], sum(edges[i] <= x < edges[i + 1] or i == n - 1 and x >= edges[i] for x in xs)) for i in range(n)]


@pytest.mark.parametrize("slots", [4096, 1])
def test_histograms_of_all_columns(spark, mixed, monkeypatch, slots):
    monkeypatch.setattr(profile, "SLOTS", slots)
    df, rows = mixed
    df = df.withColumns({"tiny": F.col("i") * 1e-308, "wide": F.when(F.col("i") % 2 == 0, 1.7e308).otherwise(-1.7e308), "none": F.lit(None).cast("double"), "one": F.lit(5.0), "third": F.col("i") / 3})
    columns = ["i", "k", "x", "m", "tiny", "wide", "none", "one", "third"]
    got = {}
    for r in profile.histograms(df, columns).collect():
        got.setdefault(r["column"], []).append((r["bin"], r["low"], r["high"], r["count"]))
    for c in columns:
        assert sorted(got.get(c, [])) == naive_bins([None if r[0] is None else float(r[0]) for r in df.select(c).collect()]), c


def test_histograms_take_two_scans(spark, mixed, monkeypatch):
    df, _ = mixed
    seen = []
    found = profile._ends
    monkeypatch.setattr(profile, "_ends", lambda *a: seen.append(a) or found(*a))
    out = profile.histograms(df, ["i", "k", "x", "m"])
    assert scans(out) == 1 and len(seen) == 1  # and one for the ends


def test_duplicates_behind_digests(spark, mixed, monkeypatch):
    df, _ = mixed
    df = df.drop("i", "ts")
    want = df.count() - df.withColumn("x", F.when(~F.isnan("x"), F.col("x"))).distinct().count()  # NaN is missing
    first = profile.dataset_stats(df).first()
    assert first.duplicate_rows == want and first.rows == 500
    monkeypatch.setattr(profile, "_digests", lambda keys: [F.lit(1).cast("long").alias("h0"), F.pmod(F.hash(*keys), F.lit(3)).cast("long").alias("h1")])
    assert profile.dataset_stats(df).first() == first
    assert tuple(profile.dataset_stats(df.where("k > 99")).first()) == (0, 0, 0, 0)
    monkeypatch.undo()
    moved = profile.dataset_stats(spark.range(100).selectExpr("id", "uuid() AS u"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(h0" in moved


def test_hash_samples(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id", "id % 13 AS g", "double(id * id % 997) AS v", "if(id % 10 = 0, null, repeat('x', int(id % 50))) AS t")
    for k in (1, 700, 4999, 5000, 9000):
        got = [r.id for r in profile.hash_sample(df.repartition(3), ["id"], k).collect()]
        assert len(got) == len(set(got)) == min(k, 5000)
        if k == 700:  # leading bits are unsigned
            again = {r.id for r in profile.hash_sample(df.repartition(17, "g"), ["id"], k).collect()}
            monkeypatch.setattr(profile, "SLOT_BITS", 11)
            assert again == set(got) == {r.id for r in profile.hash_sample(df.coalesce(1), ["id"], k).collect()}
            monkeypatch.undo()
            by = sorted(df.select("id", F.xxhash64("id").alias("h")).collect(), key=lambda r: r.h % 2**64)
            assert set(got) == {r.id for r in by[:k]}
    merged = profile.hash_sample(profile.hash_sample(df.where("g < 5"), ["id"], 100).union(profile.hash_sample(df.where("g >= 5"), ["id"], 100)), ["id"], 100)
    assert {r.id for r in merged.collect()} == {r.id for r in profile.hash_sample(df, ["id"], 100).collect()}
    same = spark.range(50).selectExpr("1 AS id", "id % 2 AS v")
    assert profile.hash_sample(same, ["id"], 30).count() == 30


def test_sampled_profile(spark):
    df = spark.range(3000).selectExpr("id", "double(id % 997) AS v", "if(id % 10 = 0, null, repeat('x', int(id % 50))) AS t")
    got = {r["column"]: r for r in profile.sampled_profile(df, ["v", "t"], ["id"], 400).collect()}
    sample = [r.v for r in profile.hash_sample(df, ["id"], 400).collect()]
    v, t = got["v"], got["t"]
    assert (v.total, v.nulls, v.min, v.max, v.min_length, v.sampled, v.median_estimate) == (3000, 0, 0.0, 996.0, None, 400, statistics.median(sample))
    sizes = [i % 50 for i in range(3000) if i % 10]
    assert (t.nulls, t.min_length, t.max_length, t.mean_length, t.min, t.median_estimate) == (300, 1, 49, statistics.fmean(sizes), None, None)
    few = profile.sampled_dataset(df.drop("id").withColumn("id", F.col("v")), ["v"], 10_000, cells=900).first()
    assert few.sampled == 300 and few.duplicate_rows <= 300


def naive_diff(before, after):
    """Changed cells by key of two lists of (key, a, b): alike rows cancel, the rest pair off in order."""
    out = Counter()
    text = lambda v: None if v is None else str(v)
    order = lambda r: tuple((v is not None, v or "") for v in r)
    for k in {r[0] for r in (*before, *after)}:
        b, a = (Counter(tuple(map(text, r[1:])) for r in rows if r[0] == k) for rows in (before, after))
        left, right = sorted((b - a).elements(), key=order), sorted((a - b).elements(), key=order)
        for x, y in zip(left, right, strict=False):
            for c, old, new in zip(("a", "b"), x, y, strict=True):
                if old != new:
                    out[(k, "changed", c, old, new)] += 1
        out[(k, "removed", None, None, None)] += max(0, len(left) - len(right))
        out[(k, "added", None, None, None)] += max(0, len(right) - len(left))
    return +out


@pytest.mark.parametrize("buckets", [1, 6])
def test_diff_of_repeated_keys(spark, buckets):
    rng = random.Random(5)
    row = lambda: (rng.choice([None, 1, 2, 2, 2, 2, 3]), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]))
    before = [row() for _ in range(300)] + [(9, 1, "z")] * 40
    after = [r if rng.random() < 0.7 else row() for r in before if rng.random() < 0.9] + [(9, 1, "z")] * 30 + [(10, 5, None)]
    kind = "k int, a int, b string"
    got = step_diff(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind), ["k"], buckets)
    assert Counter((r.k, r.change, r.column, r.old, r.new) for r in got.collect()) == naive_diff(before, after)
    assert got.columns == ["k", "change", "column", "old", "new"]


def test_a_hot_key_makes_no_square(spark):
    a, b = (spark.range(3000).selectExpr("1 AS k", f"id + {n} AS v") for n in (0, 1000))
    counts = {r.change: r.cells for r in diff_counts(step_diff(a, b, ["k"], 4)).collect()}
    assert counts == {"changed": 1000}
    only_keys = step_diff(spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int"), ["k"])
    assert sorted((r.k, r.change) for r in only_keys.collect()) == [(1, "removed"), (2, "removed"), (3, "added")]
    none = a.where("k > 1")
    assert step_diff(none, none, ["k"]).collect() == []
