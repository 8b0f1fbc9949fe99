"""Text in and out: files of lines, separated logs, result files by timescale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, column: str = "line", skip_first: bool = False) -> DataFrame:
    """One row for each line of the files; skip_first leaves out the first line of each file."""
    if skip_first:
        return spark.read.option("header", True).option("sep", "\n").option("quote", "").schema(f"{column} string").csv(path)
    return spark.read.text(path).withColumnRenamed("value", column)


def stream_lines(spark: SparkSession, path: str, column: str = "line") -> DataFrame:
    return spark.readStream.text(path).withColumnRenamed("value", column)


def separated(spark: SparkSession, path: str, keep: int = 2, sep: str = "|", column: str = "word") -> DataFrame:
    """One field of each line of a separated log, counted from 0; lines that are too short give null."""
    return spark.read.text(path).select(F.get(F.split("value", "\\" + sep), F.lit(keep)).alias(column))


def write_by_timescale(df: DataFrame, path: str, mode: str = "append", form: str = "parquet") -> None:
    """Results in folders w=.../i=...; one task writes one timescale's part of its rows, without a shuffle."""
    df.write.mode(mode).partitionBy("w", "i").format(form).save(path)


def write_totals(totals: DataFrame, path: str, value: str = "total", mode: str = "append", deps: str | None = None) -> None:
    """Tab-separated lines window_end, total[, deps] in folders w=.../i=...; deps: a column with how many slices and windows each was merged from."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("window_end", value, deps) if c])
    totals.select("w", "i", line.alias("value")).write.mode(mode).partitionBy("w", "i").text(path)


def write_lines(df: DataFrame, path: str, column: str, mode: str = "append") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)
