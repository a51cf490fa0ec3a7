"""A corpus pipeline of five stages over `documents`, each written as Parquet and read again for the next.

A stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. The filters drop rows,
line dedup rewrites `text` and `n_chars`, and the last stage returns the sampled segmentations of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanframe.llm import decontam, langid, linededup, neardup, segment
from cleanframe.llm.common import drop_path, fresh_path
from cleanframe.llm.queries import piece_model

#: SQL can't express training, fingerprint search, edit matching or sampling: tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; null texts, texts without a letter and low scores go."""
    return langid.recognised(docs, langid.train(langid.learned(docs)), least=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from the texts; all documents stay, also where no line is left."""
    kept = linededup.deduped_rows(docs, min_chars=40, min_docs=5)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return neardup.without_near_duplicates(docs, ngram=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), error_rate=0.2, min_words=8)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document left, as digests, with their decoding checked."""
    return segment.sample_digests(docs, piece_model(), k=2, alpha=0.5)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("benchmark_decontamination", benchmark), ("sentencepiece", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result but the last is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
