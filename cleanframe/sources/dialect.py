"""Delimiters and headers of the delimited files of a directory, guessed in one Spark job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELIMITERS = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|"}


QUOTES = ('"', "'")


def _quoted_fields(delimiter: str, quote: str) -> str:
    """A pattern of a field in quotes between delimiters, quotes in it doubled."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    return f"(?:^|(?<={d})){quote}(?:[^{quote}]|{quote}{quote})*{quote}(?={d}|\\s*$)"


def dialect_scores(lines: DataFrame) -> DataFrame:
    """`file, delimiter, quote, fields, share, quoted, header`, the best delimiter of each file.

    `lines(file, line)` are sample lines. For every delimiter, lines are counted by their number of fields outside
    quotes; the delimiter with the largest share of lines of one width wins, the wider one on ties. Single quotes are a
    delimiter's where they enclose more fields than double quotes do and at least two, or one where that makes more lines
    agree in width: apostrophes in prose are none.
    The header is likely where the first line has no number and later lines have some. A file of one line, such as Spark
    writes for a first task without rows, shows neither quotes nor a header, and a single field in single quotes may be
    prose: such a file has the dialect that most of the other files with the same first line have, or its own where there
    are none.
    """
    number: Column = F.regexp_like("line", F.lit(r"(^|[,;|\t])\s*['\"]?[+-]?\d+(\.\d+)?['\"]?\s*($|[,;|\t])"))

    def cell(name: str, delimiter: str, quote: str) -> Column:
        pattern = _quoted_fields(delimiter, quote)
        bare = F.regexp_replace("line", pattern, "")
        fields = F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1
        return F.struct(F.lit(name).alias("delimiter"), F.lit(quote).alias("quote"), fields.alias("fields"), F.regexp_count("line", F.lit(pattern)).alias("enclosed"))

    cells = F.array(*[cell(n, d, q) for n, d in DELIMITERS.items() for q in QUOTES])
    widths = lines.select("file", F.inline(cells)).groupBy("file", "delimiter", "quote", "fields").agg(F.count("*").alias("count"), F.sum("enclosed").alias("enclosed"))
    each = widths.groupBy("file", "delimiter", "quote").agg(F.max(F.struct("count", "fields")).alias("m"), F.sum("count").alias("n"), F.sum("enclosed").alias("enclosed"))
    score = lambda q: F.max(F.when(F.col("quote") == q, F.struct("m", "n", "enclosed")))
    both = each.groupBy("file", "delimiter").agg(score('"').alias("double"), score("'").alias("single"))
    agree = F.col("single.m.count") > F.col("double.m.count")
    by_single = (F.col("single.enclosed") > F.col("double.enclosed")) & ((F.col("single.enclosed") >= 2) | agree)
    unsure = ~by_single & (F.col("single.enclosed") > F.col("double.enclosed"))
    best = both.select("file", "delimiter", F.when(by_single, F.lit("'")).otherwise(F.lit('"')).alias("quote"), F.when(by_single, F.col("single")).otherwise(F.col("double")).alias("s"), unsure.alias("unsure"))
    rank = F.struct((F.col("s.m.fields") > 1).alias("splits"), (F.col("s.m.count") / F.col("s.n")).alias("share"), F.col("s.m.fields").alias("fields"), "delimiter", "quote", F.col("s.enclosed").alias("enclosed"), "unsure")
    pick = best.groupBy("file").agg(F.max(rank).alias("s"))
    heads = lines.groupBy("file").agg(F.max(F.when(F.col("nr") == 1, number)).alias("h"), F.max(F.when(F.col("nr") > 1, number)).alias("b"), F.min_by("line", "nr").alias("first"), F.count(F.lit(1)).alias("n"))
    header = ~F.coalesce("h", F.lit(False)) & F.coalesce("b", F.lit(False))
    named = {"delimiter": F.col("s.delimiter"), "quote": F.col("s.quote"), "fields": F.col("s.fields").cast("long"), "share": F.col("s.share"), "quoted": F.col("s.enclosed") > 0, "header": header}
    own = pick.join(heads, "file").select("file", "first", (F.col("s.unsure") | (F.col("n") == 1)).alias("thin"), F.struct(*[c.alias(k) for k, c in named.items()]).alias("own"))
    votes = own.where("not thin").groupBy("first", *[F.col(f"own.{k}").alias(k) for k in named if k != "share"]).agg(F.count(F.lit(1)).alias("files"), F.max("own.share").alias("share"))
    like = votes.groupBy("first").agg(F.max_by(F.struct(*named), F.struct("files", "share", *[k for k in named if k != "share"])).alias("like"))
    verdict = F.when(F.col("thin"), F.coalesce("like", "own")).otherwise(F.col("own"))
    return own.join(like, "first", "left").select("file", verdict.alias("v")).select("file", "v.*")


def dialects(spark: SparkSession, path: str, sample: int = 100, encoding: str = "UTF-8") -> DataFrame:
    """`dialect_scores` of the files under `path`, from the first `sample` lines of each (a sampling operator).

    Only a file's first block is looked at, and of it no more than the sample leaves a task.
    """
    first = spark.read.option("encoding", encoding).text(path).where(F.col("_metadata.file_block_start") == 0)
    marked = first.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    # row_number() <= n is cut in every task before the shuffle
    numbered = marked.withColumn("nr", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("nr") <= sample)
    lines = numbered.select("file", "nr", "line").where(F.trim("line") != "")
    return dialect_scores(lines)
