"""Texts in and parsed rows out: files, tables, and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parsing takes a millisecond for a row at most: a task's work stays the same however large the table.
ROWS_PER_TASK = 50_000


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each line; a large file is split over tasks."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table dealt over all cores, and over tasks of ``ROWS_PER_TASK`` at most, if they lie in fewer partitions (one small
    file is one, and a file of few bytes may hold many rows): for work that costs more than moving them. The rows are counted, which
    reads no column."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def write_rows(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format(kind).save(path)
