"""What the training-data operators share: row keys, written tables, ASCII text rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every word and line rule here: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or the context's checkpoint folder.

    Where neither is set, a local session gets one of its own, as in tests; a cluster raises, for executors would write
    to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.cleanframe.shared.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cleanframe-")
        spark.conf.set("spark.cleanframe.shared.dir", folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch: texts may be long, and a task holds a batch of them and what it makes of it.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a Spark context, so that Python stages can import it there.

    Batches of more than BATCH_ROWS rows are made smaller for the session: they are what bounds a Python task's memory."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_cleanframe_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="cleanframe-")) / "cleanframe.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))
    sc._cleanframe_shipped = True


@lru_cache(1)
def _trim():
    """glibc's `malloc_trim`; elsewhere nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def lean(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A Python task that, after each batch that it gives, hands memory it has freed back to the system.

    Allocators keep it otherwise, for as long as Spark keeps the worker: through the stages that follow too."""

    @wraps(task)
    def run(*args):
        for batch in task(*args):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
            _trim()(0)
        _trim()(0)

    return run


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's switch to delete a query's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: it cuts the lineage, outlives executors, and is columnar.

    The shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, what), spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that no later plan reads."""
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            drop_path(df.sparkSession, folder)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. `lower` is the fast path where the text has ASCII only."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def words_of(c: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; empty for null or blank text."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, "[ \\t-\\r]+"))


def fold(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null counts as the text ''."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """(rows of `_k long, _id, _text` and the columns of `more` as `_m0, ...`, whether `_k` is the id itself).

    `_k` is unique, never null and ordered as the id. Where ids are whole numbers, unique and not null, it is
    the id. Otherwise rows are numbered by (id with nulls last, text, more), so repeated ids and null ids are rows of
    their own with a fixed order. Only the named columns are read: extra columns can't clash.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"_m{i}") for i, c in enumerate(more)])
    names = [f"_m{i}" for i in range(len(more))]
    if isinstance(rows.schema["_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        counts = rows.groupBy("_id").count()
        odd = counts.where(F.col("_id").isNull() | (F.col("count") > 1)).limit(1).count()
        if not odd:
            return rows.select(F.col("_id").cast("long").alias("_k"), "_id", "_text", *names), True
    ordered = rows.orderBy(F.col("_id").asc_nulls_last(), F.col("_text").asc_nulls_first(), *names)
    schema = T.StructType([T.StructField("_k", T.LongType()), *rows.schema.fields])
    numbered = df.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (x[1], *x[0])), schema)
    return written(numbered, "keyed"), False


def as_binary(df: DataFrame) -> DataFrame:
    """`_k, _b`: the key and the text's UTF-8 bytes (null: empty), as Python stages read them."""
    return df.select("_k", F.coalesce("_text", F.lit("")).cast("binary").alias("_b"))
