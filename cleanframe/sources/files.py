"""Readers and writers of delimited text, JSON Lines and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.sources.quoted import BY_LINE, read_quoted


def wide_units(encoding: str) -> bool:
    """Whether a line end is more than one byte in this encoding."""
    return len("\n".encode(encoding)) > 1


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8", quote: str = '"', header: bool = True, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV or TSV files. Without a schema, one more pass infers it. Files of blank lines alone give no column.

    Without a delimiter, paths that end in .tsv are split at tabs, others at commas. Files are split among tasks
    at line ends. With `multi_line` quoted fields may hold line ends, and files are split all the same (`read_quoted`)
    if they are UTF-8, Latin-1 or ASCII. UTF-8 bytes that are no text become replacement characters. In encodings whose
    line end is no single byte, such as UTF-16, a file is one task's: its bytes don't show where a character begins.
    """
    wide = wide_units(encoding)
    delimiter = delimiter or ("\t" if path.lower().rstrip("/").endswith(".tsv") else ",")
    if schema is None:
        lines = spark.read.option("encoding", encoding).text(path, wholetext=wide)
        if lines.where(F.btrim(F.translate("value", "﻿", ""), F.lit(" \t\r\n")) != "").limit(1).count() == 0:
            return spark.createDataFrame([], T.StructType([]))
    if multi_line and encoding.lower() in BY_LINE:
        return read_quoted(spark, path, delimiter, quote, encoding, header, schema)
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("quote", quote).option("escape", quote).option("header", header).option("multiLine", wide or multi_line)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", encoding: str = "UTF-8", quote: str = '"', header: bool = True, mode: str = "errorifexists") -> None:
    """A directory of delimited files; an existing target is an error unless `mode` says otherwise."""
    df.write.mode(mode).option("sep", delimiter).option("encoding", encoding).option("quote", quote).option("escape", quote).option("header", header).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
