"""Unified diffs as rows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """(pr, line_no, text) of a folder's .diff files, one change set each; pr is the file's name without its ending."""
    return read_lines(spark, path, F.regexp_replace("_metadata.file_name", r"\.diff$", ""), "*.diff")


def read_lines(spark: SparkSession, path: str, key: Column, names: str = "*", line_sep: str | None = None) -> DataFrame:
    """(pr, line_no, text): the lines of text files, numbered from 0 within a key (which may use _metadata and partition
    columns), files of a key in the order of their names. line_sep: by default any of the usual line ends.

    Files are read in splits like any other, so one of any size is many tasks. A split's rows come in order, so a line's
    place among the rows of its split and file is known there; what is added to it are the lines of the splits before.
    """
    reader = spark.read.option("pathGlobFilter", names)
    rows = (reader.option("lineSep", line_sep) if line_sep else reader).text(path)
    read = rows.select(key.alias("pr"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("text"))
    starts = read.groupBy("pr", "__file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("pr").orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each split of a file
    bases = starts.select(F.col("pr").alias("__pr"), F.col("__file").alias("__f"), F.col("__block").alias("__b"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"))
    found = read.join(bases, (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")) & F.col("pr").eqNullSafe(F.col("__pr")))
    return found.select("pr", (F.col("__base") + F.col("__id")).alias("line_no"), "text")


def lines(diffs: DataFrame, key: str = "pr", text: str = "diff") -> DataFrame:
    """(key, line_no, text): the lines of whole diffs, numbered from 0. A null diff has none."""
    return diffs.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\R$", ""), r"\R")).alias("line_no", "text"))
