"""What a step changes: rows, columns and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleanframe.functions.types import all_of, named
from cleanframe.plans.frame import Frame, SortRule
from cleanframe.plans.ranges import BUCKET_ROWS, running_sum


def step_diff(before: DataFrame, after: DataFrame, key: list[str], buckets: int | None = None) -> DataFrame:
    """`keys..., change, column, old, new`: every added or removed row and every changed cell, as text.

    Rows are matched by `key`, nulls equal to nulls, over the whole tables. Where a key repeats, its rows are aligned as
    multisets: rows alike on both sides cancel by their counts, and what is left of either side is numbered in the order of
    its cells and paired by number; so n rows of a key meet m others in as many pairs as the fewer, never n times m.
    Numbers come from a window by key, and from range buckets for keys of more than BUCKET_ROWS rows: a key that most rows
    share is spread. Only columns in both are compared; see
    `column_diff` for the others. Take `.limit(n)` for a page, `.count()` for the total.
    """
    shared = [c for c in before.columns if c in after.columns and c not in key]
    names, cells = [f"k{i}" for i in range(len(key))], [f"c{i}" for i in range(len(shared))]

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(*[named(c).alias(k) for c, k in zip(key, names, strict=True)], *[named(c).cast("string").alias(x) for c, x in zip(shared, cells, strict=True)], F.lit(n).cast("long").alias("n"))

    # alike rows of both sides are one group; the sum is what one side has more of
    rows = side(before, -1).union(side(after, 1))
    net = lambda df: df.groupBy(*names, *cells).agg(F.sum("n").alias("n")).where("n <> 0").select(*names, (F.col("n") > 0).alias("side"), *cells, F.abs("n").alias("n"))
    by = tuple(SortRule(c, nulls="first") for c in cells)
    ranged = lambda df: running_sum(Frame(net(df), by), [*names, "side"], F.col("n"), "upto", buckets).select(*names, "side", *cells, "n", "upto")
    if buckets is not None:
        numbered = ranged(rows)
    else:
        # most keys have few rows, whose numbers one shuffle by key gives; keys of more rows than a bucket go by ranges
        hot = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BUCKET_ROWS).select(*[F.col(k).alias(f"h{k}") for k in names])
        some = hot.limit(1).count() > 0
        is_hot = all_of([F.col(k).eqNullSafe(F.col(f"h{k}")) for k in names])
        few = rows.join(F.broadcast(hot), is_hot, "left_anti") if some else rows
        few = few.repartition(*names) if names else few
        here = Window.partitionBy(*names, "side").orderBy(*[c.expression() for c in by]).rowsBetween(Window.unboundedPreceding, 0)
        numbered = net(few).withColumn("upto", F.sum("n").over(here)).select(*names, "side", *cells, "n", "upto")
        if some:
            numbered = numbered.union(ranged(rows.join(F.broadcast(hot), is_hot, "left_semi")))
    each = numbered.select(*names, "side", *cells, F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("at"))
    # the rows of a number are one of each side at most: an aggregate pairs them, by the same keys as before
    row = F.struct(F.lit(True).alias("there"), *cells)
    both = each.groupBy(*names, "at").agg(F.max(F.when(~F.col("side"), row)).alias("o"), F.max(F.when(F.col("side"), row)).alias("a"))
    both = both.select(*names, F.col("o.there").alias("was"), F.col("a.there").alias("is"), *[F.col(f"{s}.{c}").alias(f"{n}{i}") for s, n in (("o", "o"), ("a", "n")) for i, c in enumerate(cells)])
    cell = lambda change, column, old, new: F.struct(F.lit(change).alias("change"), F.lit(column).cast("string").alias("column"), old.cast("string").alias("old"), new.cast("string").alias("new"))
    none = F.lit(None)
    changed = F.array(*[cell("changed", c, F.col(f"o{i}"), F.col(f"n{i}")) for i, c in enumerate(shared)]) if shared else F.array().cast("array<struct<change:string,column:string,old:string,new:string>>")
    found = F.when(F.col("is").isNull(), F.array(cell("removed", None, none, none))).when(F.col("was").isNull(), F.array(cell("added", None, none, none))).otherwise(F.filter(changed, lambda x: ~x["old"].eqNullSafe(x["new"])))
    return both.select(*[F.col(k).alias(c) for c, k in zip(key, names, strict=True)], F.inline(found))


def diff_counts(diff: DataFrame) -> DataFrame:
    """`change, cells`."""
    return diff.groupBy("change").agg(F.count("*").alias("cells"))


def column_diff(before: DataFrame, after: DataFrame) -> dict[str, list[str]]:
    return {"added": [c for c in after.columns if c not in before.columns], "removed": [c for c in before.columns if c not in after.columns]}
