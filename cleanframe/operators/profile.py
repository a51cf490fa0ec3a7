"""Column and table profiles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.types import kind_of, missing, named, rows_only, valid
from cleanframe.functions.types import field as field_of
from cleanframe.operators.numeric import finite
from cleanframe.plans.filters import ascii_folded
from cleanframe.plans.frame import whole_number
from cleanframe.plans.ranges import group_middles

#: Texts longer than this are counted by their SHA-256.
TEXT_BYTES = 64
#: Top values kept, and bins of a histogram at most.
TOP, BINS = 10, 20
#: Distinct values, by estimate, up to which an exact median is one aggregate.
MEDIAN_VALUES = 1_000_000
#: Slots that tell few distinct values of a column from many.
SLOTS = 4096
#: Rows and cells of a sample; slots of its hashes, as a power of two, and how many are summed up for the driver.
SAMPLE_ROWS, SAMPLE_CELLS, SLOT_BITS, SLOT_GROUP = 100_000, 5_000_000, 20, 1024


def canonical(df: DataFrame, name: str) -> Column:
    """The value as text that is equal for equal values: JSON with map entries in order, base64 for bytes."""
    kind, c = kind_of(df, name), valid(df, name)
    data = field_of(df, name).dataType
    if kind == "binary":
        return F.base64(c)
    if isinstance(data, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if kind in ("list", "struct"):
        return F.to_json(c)
    if kind == "float":
        return F.when(c == 0, F.lit(0.0)).otherwise(c).cast("string")
    return c.cast("string")


def _key(df: DataFrame, name: str) -> Column:
    return canonical(df, name) if kind_of(df, name) in ("list", "struct", "binary") else valid(df, name)


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """`j, state, s, n, x`: a row for each cell of the columns: the column's place, whether the cell is a value (0), null (1) or NaN
    (2), and the value as a text, a long or a double. Texts of over TEXT_BYTES bytes are (3) by their SHA-256."""

    def cell(j: int, name: str) -> Column:
        kind, c = kind_of(df, name), named(name)
        data = field_of(df, name).dataType
        state = F.when(c.isNull(), 1)
        text, whole, real = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("double")
        if kind == "float":
            # nothing but the sign tells the two zeros apart
            state, real = state.when(F.isnan(c), 2), F.when(~F.isnan(c), F.when(c == 0, F.lit(0.0)).otherwise(c.cast("double")))
        elif kind in ("integer", "boolean", "date", "datetime") and not isinstance(data, T.DecimalType):
            whole = whole_number(c, kind, data)
        else:
            long = canonical(df, name)
            far = F.octet_length(long) > TEXT_BYTES
            state, text = state.when(far, 3), F.when(far, F.sha2(long.cast("binary"), 256)).otherwise(long)
        return F.struct(F.lit(j).alias("j"), state.otherwise(0).alias("state"), text.alias("s"), whole.alias("n"), real.alias("x"))

    return df.select(F.inline(F.array(*[cell(j, c) for j, c in enumerate(columns)])))


def base_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`column, total, nulls, nans, distinct` of any number of columns, from one scan.

    Cells are counted as (column, value) pairs with map-side partial counts, and the pairs again by column.
    """
    rows_only(df, "profile")
    columns = columns or df.columns
    pairs = _cells(df, columns).groupBy("j", "state", "s", "n", "x").agg(F.count(F.lit(1)).alias("c"))
    each = pairs.groupBy("j").agg(F.sum("c").alias("t"), *[F.sum(F.when(F.col("state") == i, F.col("c")).otherwise(0)).alias(f"s{i}") for i in (1, 2)], F.count_if(F.col("state").isin(0, 3)).alias("d"))
    # one row, so that a table without rows has its zeros
    made = F.map_from_entries(F.collect_list(F.struct("j", F.struct("t", "s1", "s2", "d"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), *[zero(F.col("m")[F.lit(j)][f]).alias(n) for f, n in (("t", "total"), ("s1", "nulls"), ("s2", "nans"), ("d", "distinct"))]) for j, c in enumerate(columns)])
    return each.agg(made.alias("m")).select(F.inline(cells))


def numeric_summary(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """`column, min, max, mean, median, std, sum` as doubles, over finite values; `exact=False` approximates the median.

    Exact medians of columns of up to MEDIAN_VALUES distinct values come from one aggregate, which holds them all;
    those of all others are found together by rank (`group_middles`, the columns being the groups), so that no task holds
    a column and no column needs jobs of its own.
    """
    rows_only(df, "profile")
    made, value = [], lambda c: finite(named(c).cast("double"))
    wide = set()
    if exact:
        found = df.agg(*[F.approx_count_distinct(value(c)).alias(f"d{j}") for j, c in enumerate(columns)]).first()
        wide = {c for c, n in zip(columns, found, strict=True) if n > MEDIAN_VALUES}
    far = {}
    if wide:
        each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("k"), value(c).alias("v")) for c in columns if c in wide])))
        far = {r["k"]: (r["__low"], r["__high"]) for r in group_middles(each, [F.col("k")], ["k"], F.col("v")).collect()}
    for j, c in enumerate(columns):
        v = value(c)
        total = F.sum(v) if kind_of(df, c) == "float" else F.try_sum(named(c).cast("decimal(38,0)") if kind_of(df, c) == "integer" else named(c)).cast("double")
        if c in far:
            low, high = far[c]
            middle = F.lit(low / 2 + high / 2)
        else:
            middle = F.median(v) if exact else F.percentile_approx(v, 0.5)
        made += [F.min(v).alias(f"a{j}"), F.max(v).alias(f"b{j}"), F.avg(v).alias(f"c{j}"), middle.alias(f"d{j}"), F.stddev_samp(v).alias(f"e{j}"), total.alias(f"f{j}")]
    names = ("min", "max", "mean", "median", "std", "sum")
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"{x}{j}").alias(n) for x, n in zip("abcdef", names, strict=True)]) for j, c in enumerate(columns)]
    return df.agg(*made).select(F.inline(F.array(*cells)))


def text_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """`column, empty, min_length, max_length, mean_length` of text columns, in code points."""
    rows_only(df, "profile")
    made = []
    for j, c in enumerate(columns):
        n = F.length(named(c).cast("string"))
        made += [F.count(F.when(n == 0, 1)).alias(f"a{j}"), F.min(n).cast("long").alias(f"b{j}"), F.max(n).cast("long").alias(f"c{j}"), F.avg(n).alias(f"d{j}")]
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"a{j}").alias("empty"), F.col(f"b{j}").alias("min_length"), F.col(f"c{j}").alias("max_length"), F.col(f"d{j}").alias("mean_length")) for j, c in enumerate(columns)]
    return df.agg(*made).select(F.inline(F.array(*cells)))


def boolean_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """`column, true_count, false_count`."""
    made = [x for j, c in enumerate(columns) for x in (F.count_if(named(c)).alias(f"a{j}"), F.count_if(~named(c)).alias(f"b{j}"))]
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"a{j}").alias("true_count"), F.col(f"b{j}").alias("false_count")) for j, c in enumerate(columns)]
    return df.agg(*made).select(F.inline(F.array(*cells)))


def time_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """`column, first, last` of dates and times, as text."""
    made = [x for j, c in enumerate(columns) for x in (F.min(named(c)).alias(f"a{j}"), F.max(named(c)).alias(f"b{j}"))]
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"a{j}").cast("string").alias("first"), F.col(f"b{j}").cast("string").alias("last")) for j, c in enumerate(columns)]
    return df.agg(*made).select(F.inline(F.array(*cells)))


def top_values(df: DataFrame, columns: list[str], k: int = TOP) -> DataFrame:
    """`column, value, count, rank`: the k most frequent present values of each column, ties by text.

    All columns are counted in one scan, as (column, value) pairs with map-side partial counts.
    """
    rows_only(df, "profile")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), canonical(df, c).alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).where("value is not null").groupBy("column", "value").count()
    # the group limit below the window keeps k rows a column in every task: all counts are never sorted together
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("column", "value", "count", F.col("rank").cast("long").alias("rank"))


def _reals(df: DataFrame, columns: list[str]) -> list[Column]:
    value = lambda c: finite(named(c).cast("double"))
    return [F.when(value(c) == 0, F.lit(0.0)).otherwise(value(c)) for c in columns]


def _ends(df: DataFrame, columns: list[str], bins: int) -> dict[int, tuple[float, float, int]]:
    """Of each column with a finite value: the least, the largest, and the number of distinct ones up to `bins`.

    Values are dealt into SLOTS by hash. A slot whose least and largest value are equal has one value, another two or more:
    that settles the number, but for a column of few values two of which share a slot; those few columns are counted.
    """
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(j).alias("j"), v.alias("v")) for j, v in enumerate(_reals(df, columns))]))).where("v is not null")
    slots = pairs.groupBy("j", F.pmod(F.xxhash64("v"), F.lit(SLOTS)).alias("slot")).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    found = slots.groupBy("j").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(2)).alias("n"), F.count_if(F.col("a") < F.col("b")).alias("shared")).collect()
    out = {r["j"]: (r["a"], r["b"], r["n"]) for r in found}
    unsure = [r["j"] for r in found if r["shared"] and r["n"] < bins]
    if unsure:
        for r in pairs.where(F.col("j").isin(unsure)).distinct().groupBy("j").count().collect():
            out[r["j"]] = (*out[r["j"]][:2], r["count"])
    return out


def histograms(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """`column, bin, low, high, count`: equal bins over the finite values of each column, closed on the left, the last on both
    sides; columns without such a value have none.

    As many bins as there are distinct values, `bins` at most. Edges are weighted means of both ends, so that they
    don't overflow; a value at an edge is put right against the edges themselves, not against a quotient. Two scans
    for any number of columns: the ends of all, then (column, bin) pairs with map-side partial counts.
    """
    rows_only(df, "profile")
    ends, specs, rows = _ends(df, columns, bins), [], []
    for j, c in enumerate(columns):
        if j not in ends:
            specs.append({"j": j, "n": 0, "edges": []})
            continue
        low, high, distinct = ends[j]
        n = 1 if low == high else max(1, min(bins, distinct))
        edges = [low * ((n - i) / n) + high * (i / n) for i in range(n)] + [high]
        specs.append({"j": j, "n": n, "edges": edges})
        rows += [(c, j, i, edges[i], edges[i + 1]) for i in range(n)]
    # the edges of all columns are one literal
    spec = F.from_json(F.lit(json.dumps(specs)), "array<struct<j:int,n:int,edges:array<double>>>")
    v, e, n = F.col("v"), F.col("e.edges"), F.col("e.n")
    each = df.select(F.inline(F.arrays_zip(F.array(*_reals(df, columns)).alias("v"), spec.alias("e")))).where("v is not null")
    low, high = F.get(e, F.lit(0)), F.get(e, n)
    width = F.greatest(high / n - low / n, F.lit(5e-324))
    at = F.greatest(F.lit(0), F.least(n - 1, F.floor((v / n - low / n) / width * n).cast("int")))
    guess = each.select(v, e.alias("edges"), n.alias("n"), F.col("e.j").alias("j"), at.alias("b"))
    fixed = F.when(F.col("v") < F.get("edges", F.col("b")), F.col("b") - 1).when((F.col("b") < F.col("n") - 1) & (F.col("v") >= F.get("edges", F.col("b") + 1)), F.col("b") + 1).otherwise(F.col("b"))
    counts = guess.groupBy("j", F.least(F.greatest(fixed, F.lit(0)), F.col("n") - 1).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.createDataFrame(rows, "column string, j int, bin long, low double, high double")
    return frame.join(counts, ["j", "bin"], "left").select("column", "bin", "low", "high", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """`bin, low, high, count`: `histograms` of one column."""
    return histograms(df, [column], bins).drop("column")


def _digests(keys: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(i), *keys).alias(f"h{i}") for i in (0, 1)]


def dataset_stats(df: DataFrame) -> DataFrame:
    """One row: rows, missing_cells, rows_with_missing, duplicate_rows (rows beyond the first of equal ones).

    Rows are counted by digest first; only rows whose digest repeats are compared whole, so that a collision of digests
    counts nothing and a table of different rows shuffles no more than digests.
    """
    rows_only(df, "profile")
    gone = [missing(df, c) for c in df.columns]
    keys = [_key(df, c) for c in df.columns]
    marks = _digests(keys)
    flags = sum((F.when(g, 1).otherwise(0) for g in gone), F.lit(0)).cast("long")
    by = df.select(*marks, flags.alias("m")).groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.count_if(F.col("m") > 0).alias("w"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    base = by.agg(zero("n").alias("rows"), zero("m").alias("missing_cells"), zero("w").alias("rows_with_missing"))
    names = [f"c{i}" for i in range(len(keys))]
    repeated = by.where("n > 1").select("h0", "h1")
    whole = df.select(*marks, *[k.alias(n) for k, n in zip(keys, names, strict=True)]).join(repeated, ["h0", "h1"], "left_semi")
    twice = whole.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    return base.crossJoin(F.broadcast(twice)).select("rows", "missing_cells", "rows_with_missing", "duplicate_rows")


def missing_by_column(df: DataFrame) -> DataFrame:
    """`column, missing`."""
    made = [F.count(F.when(missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)])
    return df.agg(*made).select(F.inline(cells))


def column_values(df: DataFrame, column: str, search: str = "", limit: int = 100) -> DataFrame:
    """`value, count` of the present values that hold `search` (ASCII case folded), most frequent first; limit + 1
    rows show that there are more."""
    rows_only(df, "profile")
    shown = canonical(df, column)
    rows = df.select(shown.alias("value")).where("value is not null")
    if search:
        rows = rows.where(ascii_folded(F.col("value")).contains(search.lower() if search.isascii() else search))
    return rows.groupBy("value").count().orderBy(F.desc("count"), "value").limit(limit + 1)


def hash_sample(df: DataFrame, key: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The `rows` rows of the least hashes of `key` (all, where there are no more): the same for any partitioning, and mergeable:
    the least of several samples are the sample of all.

    One narrow aggregate counts hashes by their leading bits and so finds the slot that the last row falls into; a filter keeps
    the slots below it, and the few rows of that slot are ranked by hash, key and row. Name a key that tells rows apart.
    """
    rows_only(df, "profile")
    h = F.xxhash64(*[named(k) for k in key])
    slot = F.shiftrightunsigned(h, 64 - SLOT_BITS).cast("int")
    counts = df.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.floor(F.col("slot") / SLOT_GROUP)).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    groups = counts.groupBy(F.floor(F.col("slot") / SLOT_GROUP).alias("g")).agg(F.sum("n").alias("n")).orderBy("g").collect()
    before, last = 0, None
    for r in groups:  # at most 2 ** SLOT_BITS / SLOT_GROUP rows
        if before + r["n"] >= rows:
            inside = counts.where(F.floor(F.col("slot") / SLOT_GROUP) == r["g"]).select("slot", "n", (upto + before).alias("u")).where(F.col("u") >= rows).orderBy("slot").first()
            last, before = inside["slot"], inside["u"] - inside["n"]
            break
        before += r["n"]
    if last is None:
        return df
    edge = df.where(slot == last).withColumn("__h", h)
    content = F.xxhash64(*[_key(df, c) for c in df.columns])
    # a limit keeps no more than the rows wanted in any task
    ranked = edge.orderBy("__h", *[named(k) for k in key], content).limit(rows - before).drop("__h")
    return df.where(slot < last).union(ranked)


def sampled_profile(df: DataFrame, columns: list[str], key: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """`column, total, nulls, min, max, sum, mean, std, min_length, max_length, mean_length, distinct_estimate, median_estimate, sampled`.

    Counts, ends, sums, means, deviations and text lengths cover all rows, in one aggregate with mergeable parts; numbers
    have no length and texts no moments. The median is that of `hash_sample`, and distinct values come from a sketch. A
    sampling operator: its labels say so.
    """
    rows_only(df, "profile")
    names = {"nulls": "n", "min": "a", "max": "b", "sum": "f", "mean": "m", "std": "e", "min_length": "k", "max_length": "l", "mean_length": "g", "distinct_estimate": "d"}
    made, real, none = [F.count(F.lit(1)).alias("t")], {}, F.lit(None)
    for j, c in enumerate(columns):
        text = kind_of(df, c) == "string"
        v = F.lit(None).cast("double") if text else finite(named(c).cast("double"))
        size = F.length(named(c)) if text else none.cast("int")
        real[c] = v
        made += [F.count_if(named(c).isNull()).alias(f"n{j}"), F.min(v).alias(f"a{j}"), F.max(v).alias(f"b{j}"), F.sum(v).alias(f"f{j}"), F.avg(v).alias(f"m{j}"), F.stddev_samp(v).alias(f"e{j}"), F.min(size).cast("long").alias(f"k{j}"), F.max(size).cast("long").alias(f"l{j}"), F.avg(size).alias(f"g{j}"), F.approx_count_distinct(named(c)).alias(f"d{j}")]
    sample = hash_sample(df, key, rows)
    # the sample is bounded: its exact medians fit an aggregate's buffer
    middles = sample.agg(F.count(F.lit(1)).alias("sampled"), *[F.median(real[c]).alias(f"p{j}") for j, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col("t").alias("total"), *[F.col(f"{x}{j}").alias(n) for n, x in names.items()], F.col(f"p{j}").alias("median_estimate"), "sampled") for j, c in enumerate(columns)]
    return df.agg(*made).crossJoin(F.broadcast(middles)).select(F.inline(F.array(*cells)))


def sampled_dataset(df: DataFrame, key: list[str], rows: int = SAMPLE_ROWS, cells: int = SAMPLE_CELLS) -> DataFrame:
    """One row: `sampled` rows, and of those missing_cells, rows_with_missing and duplicate_rows; `cells` bounds the sample too."""
    out = dataset_stats(hash_sample(df, key, max(1, min(rows, cells // max(1, len(df.columns))))))
    return out.withColumnRenamed("rows", "sampled")


def sampled_histogram(df: DataFrame, column: str, key: list[str], rows: int = SAMPLE_ROWS, bins: int = BINS) -> DataFrame:
    """`histogram` of `hash_sample`."""
    return histogram(hash_sample(df, key, rows), column, bins)


def sampled_top_values(df: DataFrame, columns: list[str], key: list[str], rows: int = SAMPLE_ROWS, k: int = TOP) -> DataFrame:
    """`top_values` of `hash_sample`."""
    return top_values(hash_sample(df, key, rows), columns, k)
