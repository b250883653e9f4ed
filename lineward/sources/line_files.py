"""Lines of text files of any size, numbered within their file.

A file larger than a split is read by several tasks, none of which knows how many lines came before its own. Each
line keeps the block of the file that it was read from; lines of a block are counted, and the counts of a
file's earlier blocks are added up. No file, and no more than a line of it, is ever held as one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineward.functions import keywords as K


def _placed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, block, at, raw): every line with the block that it starts in and its position among the rows of its task."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))


def line_starts(placed: DataFrame) -> DataFrame:
    """(path, block, first_at, lines_before): a row for each block of each file."""
    blocks = placed.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("path", "block", "first_at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"))


def _numbered(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``line_no`` in place of block and position. Blocks of one file are different keys, so a huge file is no hot spot."""
    number = F.col("lines_before") + F.col("at") - F.col("first_at") + 1
    return rows.join(starts, ["path", "block"]).withColumn("line_no", number).drop("block", "at", "first_at", "lines_before")


def file_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, line_no, line`` of the non-blank lines, trimmed; numbers count blank lines too.

    Lines end with a line feed only, as in ``keyword_scan.explode_lines``; a folder stands for the files in it.
    """
    placed = _placed(spark, paths)
    rows = placed.select("path", "block", "at", K.strip(F.col("raw")).alias("line")).where(F.col("line") != "")
    return _numbered(rows, line_starts(placed)).select("path", "line_no", "line")


def file_findings(spark: SparkSession, paths: list[str], keywords: list[str]) -> DataFrame:
    """``path, line_no, content, keyword`` of the matching lines; only these are joined to their numbers."""
    pattern = K.search_pattern(keywords)
    placed = _placed(spark, paths)
    if pattern is None:
        pattern, placed = "x", placed.where(F.lit(False))
    hit = placed.where(K.has_match(F.col("raw"), pattern)).select("path", "block", "at", K.strip(F.col("raw")).alias("line"))
    found = hit.withColumn("matches", K.all_matches(F.col("line"), pattern)).where(F.size("matches") > 0)
    rows = found.select("path", "block", "at", K.context(F.col("line"), F.get("matches", F.lit(0))).alias("content"),
                        K.joined_forms(F.col("matches")).alias("keyword"))
    return _numbered(rows, line_starts(placed)).select("path", "line_no", "content", "keyword")
