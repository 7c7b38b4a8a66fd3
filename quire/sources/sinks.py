"""Writing tables (create-as-select, append) and exporting results."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: Sequence[str] = (), sort_within: Sequence[str] = ()) -> str:
    """Create-table-as-select (``mode='overwrite'``) or insert (``'append'``).

    ``sort_within`` orders rows inside each output file (the reference's
    physically ordered table); Parquet min/max statistics then let later
    filters on those columns skip row groups.
    """
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


@contextmanager
def concurrent_files(spark: SparkSession, n: int):
    """Writes inside the block keep up to ``n`` files of different partitions open
    a task, instead of sorting the rows by partition (beyond ``n`` they do)."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Quotes are doubled and white space is kept, so a text reads back as it was; an
#: empty one as NULL, which CSV doesn't tell apart.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def export_csv(df: DataFrame, path: str) -> str:
    """Export a result as CSV with a header (the result table's download)."""
    df.write.mode("overwrite").options(**CSV).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An exported result, whose values may hold line ends."""
    return spark.read.options(**CSV, multiLine=True).schema(schema).csv(path)


def write_ordered(df: DataFrame, path: str, *order: Column | str) -> str:
    """A table stored in order: its files are ranges of the order, one after the
    other, each sorted inside."""
    return write_table(df.orderBy(*order), path)


def stored_places(spark: SparkSession, path: str, name: str = "place") -> DataFrame:
    """A stored table with the place of every row, from 1: files by name, then
    rows as they stand in the file. One row a file goes through the window."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_file").count().select("_file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_file", "_at", "_start")


def file_bounds(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``file, rows, low, high`` of every file of a stored table."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col(key).alias("_key"))
    return rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("_key").alias("low"), F.max("_key").alias("high"))
