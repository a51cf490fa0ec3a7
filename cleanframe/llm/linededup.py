"""Line deduplication by range-partitioned hashes, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanframe.llm.common import ascii_lower, keyed, strip, written

#: Salts of the first aggregation: a line that a third of all documents hold is summed in as many tasks.
SALTS = 16
#: Decisions are broadcast up to so many positions (about 16 MB); beyond that they are joined by shuffle.
BROADCAST_POSITIONS = 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _marks(min_chars: int) -> Column:
    """Array of structs (h1, h2, pos) of the lines in `_lines` whose key is long enough."""
    keys = F.transform(F.col("_lines"), lambda x: strip(x))
    long_ones = F.filter(F.transform(keys, lambda x, i: F.struct(x.alias("key"), i.alias("pos"))), lambda x: F.length(x["key"]) >= min_chars)
    low = F.transform(long_ones, lambda x: F.struct(ascii_lower(x["key"]).alias("key"), x["pos"].alias("pos")))
    return F.transform(low, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"), x["pos"].alias("pos")))


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """`h1, h2, _keeper`: keys of at least `min_docs` documents and the largest key `_k` holding each.

    Each document counts once for a key, whatever its positions there. Counts are summed by (hash, salt) with
    map-side partial sums, so no task gathers a hot line. The SALTS rows at most that are left of a hash are
    range-partitioned by it and sorted by hash and document, latest first; a window streams over them, and the
    first row of a hash is the occurrence that stays.
    """
    once = lines.select("_k", F.inline(F.array_distinct(F.transform("_marks", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))))
    salted = once.groupBy("h1", "h2", F.pmod(F.hash("_k"), F.lit(SALTS)).alias("_salt")).agg(F.count("*").alias("_n"), F.max("_k").alias("_last"))
    whole = Window.partitionBy("h1", "h2")
    streamed = salted.repartitionByRange("h1", "h2").select("h1", "h2", "_last", F.row_number().over(whole.orderBy(F.desc("_last"))).alias("_turn"), F.sum("_n").over(whole).alias("_docs"))
    return streamed.where((F.col("_turn") == 1) & (F.col("_docs") >= min_docs)).select("h1", "h2", F.col("_last").alias("_keeper"))


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """Run-compressed keep bitmap: array of (start, length) of the lines that stay, from sorted positions to drop."""
    starts = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) < x - 1))
    ends = F.transform(F.filter(dropped, lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) > x + 1)), lambda x: x + 1)
    spans = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("a"), F.concat(starts, F.array(n_lines)).alias("b"))
    runs = F.transform(spans, lambda x: F.struct(x["a"].alias("start"), (x["b"] - x["a"]).alias("length")))
    return F.filter(runs, lambda x: x["length"] > 0)


def apply_runs(text: Column, runs: Column) -> Column:
    """The text of the lines that `keep_runs` keeps."""
    return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines_of(text), r["start"] + 1, r["length"]))), "\n")


def _decisions(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """`_k, _dropped`: sorted positions of the lines to drop, for documents that lose any."""
    lines = rows.select("_k", lines_of(F.col("_text")).alias("_lines")).select("_k", _marks(min_chars).alias("_marks")).where(F.size("_marks") > 0)
    repeated = written(repeated_lines(lines, min_docs), "lines")
    if repeated.count() * 24 <= 16 << 20:
        repeated = F.broadcast(repeated)
    hits = lines.select("_k", F.inline("_marks")).join(repeated, ["h1", "h2"]).where(F.col("_k") != F.col("_keeper"))
    return hits.groupBy("_k").agg(F.array_sort(F.collect_list("pos")).alias("_dropped"))


def _with_runs(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    drops = written(_decisions(rows, min_chars, min_docs), "drops")
    if (drops.agg(F.sum(F.size("_dropped") + 4)).first()[0] or 0) <= BROADCAST_POSITIONS:
        drops = F.broadcast(drops)
    none = F.array().cast("array<int>")
    out = rows.join(drops, "_k", "left").withColumn("_n", F.size(lines_of(F.col("_text")))).withColumn("_dropped", F.coalesce("_dropped", none))
    return out.withColumn("_runs", keep_runs(F.col("_n"), F.col("_dropped")))


def line_bitmaps(df: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_lines, n_dropped, keep_runs`: which lines of each text stay.

    A line's key is the line without spaces (and \\x09-\\x0D) at its ends, A-Z lower-cased. Keys of at least
    `min_chars` code points in at least `min_docs` rows lose their lines but in the row with the largest id,
    where all of them stay. Null or empty text: one empty line, kept. Rows with repeated or null ids are rows
    of their own, null ids last (largest). Keys are told apart by 128 bits of hash. No text is returned.
    """
    rows, _ = keyed(df, id_col, text_col)
    out = _with_runs(rows, min_chars, min_docs)
    return out.select(F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_lines"), F.size("_dropped").cast("long").alias("n_dropped"), F.col("_runs").alias("keep_runs"))


def deduped_lines(df: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_lines, n_dropped, kept`: the bitmaps of `line_bitmaps` applied to the texts."""
    rows, _ = keyed(df, id_col, text_col)
    out = _with_runs(rows, min_chars, min_docs)
    kept = F.when(F.size("_dropped") == 0, F.coalesce("_text", F.lit(""))).otherwise(apply_runs(F.col("_text"), F.col("_runs")))
    return out.select(F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_lines"), F.size("_dropped").cast("long").alias("n_dropped"), kept.alias("kept"))


def deduped_rows(df: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, with their texts less the repeated lines (null texts stay null).

    Where ids are unique, rows find their decisions by id. Otherwise by id and a digest of the text: rows that
    share both are told apart by nothing, so that of such rows one decision, the last one's, holds for all.
    """
    rows, plain = keyed(df, id_col, text_col)
    drops = written(_decisions(rows, min_chars, min_docs), "drops")
    few = (drops.agg(F.sum(F.size("_dropped") + 4)).first()[0] or 0) <= BROADCAST_POSITIONS
    text = F.col(f"`{text_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    if plain:
        found = drops.select(F.col("_k").alias("__key"), "_dropped")
        key = F.col(f"`{id_col}`").cast("long")
    else:
        mark = lambda i, t: F.sha2(F.to_json(F.struct(i.cast("string").alias("i"), t.cast("string").alias("t"))).cast("binary"), 256)
        last = rows.withColumn("__key", mark(F.col("_id"), F.col("_text"))).groupBy("__key").agg(F.max("_k").alias("_k"))
        found = last.join(drops, "_k").select("__key", "_dropped")
        key = mark(F.col(f"`{id_col}`"), text)
    # the row goes as one struct, so that no column of its own can clash
    out = df.select(row, key.alias("__key")).join(F.broadcast(found) if few else found, "__key", "left")
    text = F.col("__row")[text_col]
    kept = F.when(F.col("_dropped").isNull() | text.isNull(), text.cast("string")).otherwise(apply_runs(text, keep_runs(F.size(lines_of(text)), F.col("_dropped"))))
    return out.select(*[(kept if c == text_col else F.col("__row")[c]).alias(c) for c in df.columns])
