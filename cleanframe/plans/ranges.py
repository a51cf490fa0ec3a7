"""Order at scale: range buckets over whole sort keys, so that no window spans the whole table; ranks and medians from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.types import all_of, kind_of, missing, named
from cleanframe.functions.types import field as field_of
from cleanframe.plans.frame import Frame, SortRule, whole_number

#: Rows of a bucket, and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 200_000, 32_768
#: Sampled keys a bucket, and in all beyond the least; they go through the driver.
SAMPLE, LEAST_SAMPLE, MOST_SAMPLE = 200, 12, 400_000
#: Characters of a text that a split point keeps.
KEY_CHARS = 256


def sort_number(df: DataFrame, column: str) -> Column:
    """A number or time as a double, for straight lines along it."""
    kind, c = kind_of(df, column), named(column)
    if kind in ("integer", "float", "decimal"):
        return c.cast("double")
    return whole_number(c, kind, field_of(df, column).dataType).cast("double")


def split_points(df: DataFrame, key: Column, buckets: int | None) -> list[str]:
    """Keys, as JSON, that cut the rows into about equal buckets by `key`, a struct of simple fields.

    Every k-th of a sorted sample of whole keys, so that keys that agree in their first fields are divided by the
    others. The sample is bounded by the number of buckets, not by the table. Its keys become a literal of the
    plan, so that a task run again puts every row into the same bucket; a poor sample makes buckets uneven, never wrong.
    """
    rows = df.count()
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(1, rows // BUCKET_ROWS))
    if buckets <= 1 or not rows:
        return []
    wanted = max(buckets * LEAST_SAMPLE, min(buckets * SAMPLE, MOST_SAMPLE))
    keys = df.select(key.alias("k"))
    # the first KEY_CHARS characters of a text cut as well
    short = [(F.substring(F.col("k")[f.name], 1, KEY_CHARS) if isinstance(f.dataType, T.StringType) else F.col("k")[f.name]).alias(f.name) for f in keys.schema["k"].dataType.fields]
    keys = keys.select(F.struct(*short).alias("k"))
    if rows > wanted:
        keys = keys.sample(wanted / rows, seed=1)
    found = [r[0] for r in keys.orderBy("k").select(F.to_json("k", {"ignoreNullFields": "false"})).collect()]
    return list(dict.fromkeys(found[len(found) * i // buckets] for i in range(1, buckets))) if found else []


def bucket(key: Column, cuts: list[str], kind: T.StructType) -> Column:
    """The number of split points below the key, by halving: a comparison for each doubling of their number."""
    if not cuts:
        return F.lit(0)
    # one literal text, which the optimizer turns into an array once
    points = F.from_json(F.lit(f"[{','.join(cuts)}]"), T.ArrayType(kind))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    # beyond the last split point there is none, and a comparison with null takes no step
    place = lambda k: F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(points, at + step - 1) < k, at + step).otherwise(at))
    # the key is worked out once as a variable of a lambda
    return F.transform(F.array(key), place)[0]


def with_buckets(frame: Frame, buckets: int | None = None, lead: list[str] | None = None) -> DataFrame:
    """`__bucket`, rising in the order of `lead` (ascending, null first) and then the frame's, by their whole key.

    Only rows that are equal in all keys must share a bucket.
    """
    key = frame.position(lead)
    fields = frame.df.select(key.alias("k")).schema["k"].dataType.fields
    # of the split points' own type, so that no comparison casts
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    return frame.df.withColumn("__bucket", bucket(key.cast(kind), split_points(frame.df, key, buckets), kind))


def anchors(frame: Frame, present: Column, carried: Column, partition: list[str] | None = None, buckets: int | None = None, positions: bool = True) -> DataFrame:
    """Adds `__pos` (place in the whole order or the partition), `__total`, and `__prev`, `__next`: structs (pos, v) of the
    nearest rows before (or at) and after (or at) each row where `present` holds, v being `carried`.

    Inside a bucket they come from windows. Across buckets a table of a row a bucket (its size, its first and last
    present row) is carried on by windows over that table alone, and joined back by broadcast. With `partition`
    buckets run over (partition, order): a partition that holds most rows spans many buckets, and only those that span
    several, at most as many as there are buckets, are in that table. Without `positions` places and
    totals are null, and the table comes from a plain aggregate, without sorting rows for it.
    """
    parts = partition or []
    df = with_buckets(frame, buckets, parts)
    order, none = frame.sort_columns(), F.lit(None).cast("long")
    whole = Window.partitionBy("__bucket", *[named(c) for c in parts])
    by_order = whole.orderBy(*order)
    marked = df.withColumn("__rn", F.row_number().over(by_order).cast("long"))
    marked = marked.withColumn("__here", F.when(present, F.struct((F.col("__rn") if positions else none).alias("pos"), carried.alias("v"))))
    so_far = by_order.rowsBetween(Window.unboundedPreceding, 0)
    # the next one is the last one of the turned order: a frame that only grows costs a step a row
    turned = whole.orderBy(F.desc("__rn"))
    near = marked.withColumn("__p", F.last("__here", ignorenulls=True).over(so_far)).withColumn("__f", F.last("__here", ignorenulls=True).over(turned.rowsBetween(Window.unboundedPreceding, 0)))
    if parts and positions:
        near = near.withColumn("__n", F.count(F.lit(1)).over(whole))

    names = [f"__k{i}" for i in range(len(parts))]
    keys = [named(c).alias(k) for c, k in zip(parts, names, strict=True)]
    value = F.when(present, carried).alias("__v")
    if positions:
        counted, place = marked.select("__bucket", *keys, value, F.col("__rn").alias("__at")), F.col("__at")
    else:
        counted = df.select("__bucket", *keys, value, frame.position().alias("__at"))
        fields = counted.schema["__at"].dataType.names
        place = F.col("__at") if len(fields) > 1 else F.col("__at")[fields[0]]
    at = F.when(F.col("__v").isNotNull(), place)
    small = counted.groupBy("__bucket", *names).agg(F.count(F.lit(1)).alias("n"), *[f("__v", at).alias(f"{n}_v") for n, f in (("last", F.max_by), ("first", F.min_by))], *[(f(at) if positions else F.lit(None).cast("long")).alias(f"{n}_pos") for n, f in (("last", F.max), ("first", F.min))])
    small = _spanning(small, names)
    small = small.select("__bucket", *names, "n", *[F.when(F.col(f"{n}_v").isNotNull(), F.struct(F.col(f"{n}_pos").alias("pos"), F.col(f"{n}_v").alias("v"))).alias(n) for n in ("last", "first")])
    run = Window.partitionBy(*names).orderBy("__bucket")
    ahead = run.rowsBetween(Window.unboundedPreceding, -1)
    sized = small.withColumn("__off", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    moved = lambda s, by: F.when(s.isNotNull(), F.struct((s["pos"] + by).alias("pos"), s["v"].alias("v")))
    sized = sized.select("__bucket", *names, "n", "__off", moved(F.col("last"), F.col("__off")).alias("last"), moved(F.col("first"), F.col("__off")).alias("first"))
    carry = sized.select(
        F.col("__bucket").alias("__b"),
        *names,
        "__off",
        F.last("last", ignorenulls=True).over(ahead).alias("__cp"),
        F.last("first", ignorenulls=True).over(Window.partitionBy(*names).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)).alias("__cn"),
        F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__sum"),
    )
    same = [F.col("__bucket") == F.col("__b"), *[named(c).eqNullSafe(F.col(k)) for c, k in zip(parts, names, strict=True)]]
    joined = near.join(F.broadcast(carry), all_of(same), "left" if parts else "inner")
    off = F.coalesce("__off", F.lit(0))
    total = F.coalesce("__sum", F.col("__n")) if parts and positions else F.col("__sum")
    return joined.withColumns({
        "__pos": F.col("__rn") + off,
        "__total": total if positions else none,
        "__prev": F.coalesce(moved(F.col("__p"), off), F.col("__cp")),
        "__next": F.coalesce(moved(F.col("__f"), off), F.col("__cn")),
    }).drop("__rn", "__here", "__p", "__f", "__n", "__b", "__off", "__cp", "__cn", "__sum", "__bucket", *names)


def _spanning(sums: DataFrame, names: list[str]) -> DataFrame:
    """Of a table of a row a bucket and partition, the partitions of several buckets: at most as many as there are buckets."""
    if not names:
        return sums
    spans = sums.groupBy(*[F.col(k).alias(f"{k}s") for k in names]).agg(F.min("__bucket").alias("lo"), F.max("__bucket").alias("hi")).where("lo < hi")
    return sums.join(F.broadcast(spans), all_of([F.col(k).eqNullSafe(F.col(f"{k}s")) for k in names]), "left_semi")


def running_sum(frame: Frame, partition: list[str], weight: Column, name: str, buckets: int | None = None) -> DataFrame:
    """Adds `name`: the sum of `weight` over the rows of the partition up to this one, in the frame's order.

    Windows run inside range buckets of (partition, order); what stands before a bucket of a partition that spans several
    comes from a table of their sums.
    """
    names = [f"__k{i}" for i in range(len(partition))]
    df = with_buckets(frame, buckets, partition).withColumn("__w", weight)
    here = Window.partitionBy("__bucket", *[named(c) for c in partition]).orderBy(*frame.sort_columns()).rowsBetween(Window.unboundedPreceding, 0)
    sums = _spanning(df.groupBy("__bucket", *[named(c).alias(k) for c, k in zip(partition, names, strict=True)]).agg(F.sum("__w").alias("__s")), names)
    ahead = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("__bucket").alias("__b"), *names, F.sum("__s").over(ahead).alias("__off"))
    same = [F.col("__bucket") == F.col("__b"), *[named(c).eqNullSafe(F.col(k)) for c, k in zip(partition, names, strict=True)]]
    out = df.withColumn(name, F.sum("__w").over(here)).join(F.broadcast(carry), all_of(same), "left")
    return out.withColumn(name, F.col(name) + F.coalesce("__off", F.lit(0))).drop("__bucket", "__w", "__b", "__off", *names)


def group_middles(df: DataFrame, by: list[Column], names: list[str], value: Column, buckets: int | None = None) -> DataFrame:
    """`names..., __low, __high`: the two middle present values (null is none, NaN too) of each group, exactly.

    Ranks are found in all groups at once: (value, count) pairs of the groups are summed by range bucket of (group, value),
    running sums over those sums tell which bucket holds each middle rank, and only the pairs of these buckets are
    ranked. Groups without a value are absent. No task holds a group: a group of most rows is spread over many
    buckets, and a value that most rows share is one pair.
    """
    rows = df.select(*[b.alias(n) for b, n in zip(by, names, strict=True)], value.alias("__v"))
    # pairs first, with map-side partial counts: buckets are looked up once a distinct value
    pairs = rows.where(~missing(rows, "__v")).groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__c"))
    pairs = with_buckets(Frame(pairs, (SortRule("__v"),)), buckets, names).withColumnRenamed("__bucket", "__b")
    counts = pairs.groupBy(*names, "__b").agg(F.sum("__c").alias("__c"))
    run = Window.partitionBy(*names)
    ranked = counts.withColumns({"__n": F.sum("__c").over(run), "__upto": F.sum("__c").over(run.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))})
    low, high = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    before = F.col("__upto") - F.col("__c")
    holds = lambda rank: (rank > before) & (rank <= F.col("__upto"))
    wanted = ranked.where(holds(low) | holds(high)).select(*[F.col(k).alias(f"{k}w") for k in names], F.col("__b").alias("__bw"), (low - before).alias("__low_at"), (high - before).alias("__high_at"))
    same = [F.col("__b") == F.col("__bw"), *[F.col(k).eqNullSafe(F.col(f"{k}w")) for k in names]]
    near = pairs.join(wanted, all_of(same)).select(*names, "__b", "__v", "__c", "__low_at", "__high_at")
    upto = F.sum("__c").over(Window.partitionBy(*names, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    # a middle rank may lie in another bucket: its place there is none of this one's
    at = near.withColumn("__upto", upto).where(((F.col("__low_at") > F.col("__upto") - F.col("__c")) & (F.col("__low_at") <= F.col("__upto"))) | ((F.col("__high_at") > F.col("__upto") - F.col("__c")) & (F.col("__high_at") <= F.col("__upto"))))
    return at.groupBy(*names).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))


def middle_values(df: DataFrame, column: str, buckets: int | None = None) -> tuple[object, object] | None:
    """The two middle values of the present ones (the same, if their number is odd), exactly, for any type with an order.

    Counts by bucket tell which bucket holds the middle ranks; only its values are ranked, as (value, count) pairs with
    map-side partial counts, so that a value that most rows share is one pair.
    """
    frame = Frame(df.where(~missing(df, column)).select(column), (SortRule(column),))
    placed = with_buckets(frame, buckets)
    counts = sorted((r[0], r[1]) for r in placed.groupBy("__bucket").count().collect())
    n = sum(c for _, c in counts)
    if not n:
        return None
    out, before = [], 0
    ranks = ((n + 1) // 2, n // 2 + 1)
    for b, c in counts:
        here = [r - before for r in ranks if before < r <= before + c]
        if here:
            pairs = placed.where(F.col("__bucket") == b).groupBy(named(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
            upto = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
            ended = pairs.select("v", upto.alias("u"), "c")
            got = ended.where(F.greatest(*[F.when((F.lit(r) > F.col("u") - F.col("c")) & (F.lit(r) <= F.col("u")), 1).otherwise(0) for r in (here[0], here[-1])]) == 1).orderBy("v").collect()
            out += [got[0]["v"], got[-1]["v"]] if len(here) == 2 else [got[0]["v"]]
        before += c
    return out[0], out[-1]
