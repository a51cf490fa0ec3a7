"""Delimited files whose quoted fields hold line ends, read in splits.

A line end is in a quoted field where an odd number of quotes stands before it in its file. So an aggregate counts each
split's quotes, the sums before a split give the state it starts in, and its lines are joined to records from there.
Only the pieces of records that cross splits are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a piece of text is: a whole record, or the end, the middle or the start of one that crosses splits.
WHOLE, TAIL_END, MIDDLE, START = range(4)
#: Types that a column of text may have, narrowest first, and the form of their values.
INFERRED = {"int": r"[+-]?\d+", "bigint": r"[+-]?\d+", "double": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", "date": r"\d{4}-\d{2}-\d{2}", "timestamp": r"\d{4}-\d{2}-\d{2}([ T].*)?", "boolean": "(?i)true|false"}


#: Encodings that lines can be decoded from one by one.
BY_LINE = {"utf-8", "utf8", "iso-8859-1", "latin1", "us-ascii", "ascii"}


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """`file, split, line`: lines in the order of each split. A carriage return stays at a line's end."""
    text = spark.read.option("lineSep", "\n").text(path)
    # the text source gives bytes as they are
    line = F.make_valid_utf8("value") if encoding.lower().startswith("utf") else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), line.alias("line"))


def _quotes(line: Column, quote: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))


def _pieces(quote: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, inside, held, begun, top = None, False, [], False, False

    def rows(kinds: list[int], texts: list[str], key: tuple[int, int], head: bool) -> pa.RecordBatch:
        n = len(texts)
        cols = [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array(kinds, pa.int32()), pa.array([head] + [False] * (n - 1), pa.bool_()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["file", "split", "kind", "head", "record"])

    def left() -> pa.RecordBatch | None:
        """What is held when a split ends."""
        return rows([START if begun else MIDDLE], ["\n".join(held)], at, top) if held else None

    for batch in batches:
        files, splits = batch.column("file").to_numpy(), batch.column("split").to_numpy()
        edges = np.flatnonzero((np.diff(files) != 0) | (np.diff(splits) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(files)], strict=True):
            if a == b:
                continue
            key = (int(files[a]), int(splits[a]))
            if key != at:
                if out := left():
                    yield out
                at, held, inside = key, [], bool(batch.column("inside")[int(a)].as_py())
                begun = not inside  # else the first piece belongs to a record of an earlier split
                top = key[1] == 0
            lines = batch.column("line").slice(int(a), int(b - a))
            odd = pc.count_substring(lines, quote).to_numpy() & 1
            state = np.logical_xor(inside, np.cumsum(odd) & 1)
            inside = bool(state[-1])
            texts, kinds, out, since = lines.to_pylist(), [], [], 0
            for end in np.flatnonzero(~state):
                piece = texts[since : end + 1]
                out.append("\n".join([*held, *piece]) if held or len(piece) > 1 else piece[0])
                kinds.append(WHOLE if begun else TAIL_END)
                begun, held, since = True, [], int(end) + 1
            held += texts[since:]
            if out:
                yield rows(kinds, out, key, top)
                top = False
    if out := left():
        yield out


def records(spark: SparkSession, path: str, quote: str = '"', encoding: str = "UTF-8") -> DataFrame:
    """`head, record`: the records of the files under `path`, quoted line ends included, from all splits at once.

    `head` marks the first record of each file. Quotes in quoted fields are doubled. The table of splits, which is broadcast,
    has a row of three numbers for each.
    """
    lines = _lines(spark, path, encoding)
    counts = lines.groupBy("file", "split").agg(F.sum(_quotes(F.col("line"), quote)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    states = counts.select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    fields = "file long, split long, kind int, head boolean, record string"
    pieces = lines.join(F.broadcast(states), ["file", "split"]).select("file", "split", "inside", "line").mapInArrow(partial(_pieces, quote), fields)
    # of records that cross splits every piece is a row: at most two a split, and the length of the records
    order = Window.partitionBy("file").orderBy("split", "kind")
    grouped = pieces.where(F.col("kind") != WHOLE).withColumn("g", F.sum(F.when(F.col("kind") == START, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = grouped.groupBy("file", "g").agg(F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("split", "kind", "record"))).alias("p"))
    every = pieces.where(F.col("kind") == WHOLE).select("head", "record").union(joined.select("head", F.array_join(F.col("p.record"), "\n").alias("record")))
    bare = F.when(F.col("head"), F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record"))
    return every.select("head", F.regexp_replace(bare, "\r$", "").alias("record")).where("record <> ''")


def inferred(rows: DataFrame) -> list[str]:
    """The narrowest type of each column of text that all its values can be read as, from one aggregate."""
    made = []
    for i, c in enumerate(rows.columns):
        v = F.col(f"`{c}`")
        made += [F.count_if(v.isNotNull() & ~(v.rlike(f"^({form})$") & v.try_cast(kind).isNotNull())).alias(f"{kind}{i}") for kind, form in INFERRED.items()]
        made.append(F.count(v).alias(f"n{i}"))
    got = rows.agg(*made).first()
    return [next((k for k in INFERRED if got[f"n{i}"] and not got[f"{k}{i}"]), "string") for i in range(len(rows.columns))]


def read_quoted(spark: SparkSession, path: str, delimiter: str, quote: str, encoding: str, header: bool, schema: T.StructType | str | None) -> DataFrame:
    """The rows of `records`. With `header` each file's first record is none of them; it names the columns where there is
    no schema, whose types are then the narrowest that fit."""
    found = records(spark, path, quote, encoding)
    body = found.where("not head") if header else found
    options = {"sep": delimiter, "quote": quote, "escape": quote, "multiLine": "true"}
    if schema is None:
        # no more than the first record is read for the names
        names = spark.read.options(**options, encoding=encoding, header=header).csv(path).columns
        names = [n.rstrip("\r") for n in names]
        kind = T.StructType([T.StructField(n, T.StringType()) for n in names])
    else:
        kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    rows = body.select(F.from_csv("record", kind.toDDL(), options).alias("r")).select("r.*")
    if schema is None:
        rows = rows.select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in zip(names, inferred(rows), strict=True)])
    return rows
