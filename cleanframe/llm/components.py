"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanframe.llm.common import dropped, written


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(roots: DataFrame) -> DataFrame:
    """`u, v`: a star for each group of `components`. They make the same groups, in one round of a next search."""
    return roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """`node, root` for every node of `links(u long, v long)`; root is the smallest node reachable.

    Each round joins the links to each node's least neighbour; no neighbour list is ever collected, so a star
    with millions of leaves is a skewed join that Spark splits. Rounds grow with the logarithm of the longest
    path. Self links are dropped; an empty table gives an empty table.
    """
    e = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select("v", "u"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _state(after)
        dropped(e)
        e = after
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
