"""The append-only search log.

Each search or discovery call appends one row ``(tab, time, language,
query, rows_returned_aka_limit, start_row_aka_offset)``. Search logs the
1-based start row the user typed (the query itself skips ``start - 1``);
discovery logs 30 and 0. Rows are appended as small Parquet files
partitioned by ``tab``; ``compact_log`` rewrites a tab's files into fewer
ones, and ``log_stats`` aggregates the log.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import QUERY_LOG_SCHEMA

SEARCH_TAB = "Search"
DISCOVERY_TAB = "Discovery"


def log_row(spark: SparkSession, tab: str, language: str, query: str, limit: int,
            offset: int, now: _dt.datetime | None = None) -> DataFrame:
    """One log row; ``now`` is injectable for tests (default: current time)."""
    df = spark.createDataFrame([(tab, now, language, query, int(limit), int(offset))],
                               QUERY_LOG_SCHEMA)
    if now is None:
        df = df.withColumn("time", F.current_timestamp())
    return df


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as they are dealt; a tab's rows are files of its own folder."""
    df.write.mode("append").partitionBy("tab").parquet(path)


def log_search(spark: SparkSession, path: str, language: str, query: str,
               limit: int, start: int, now: _dt.datetime | None = None) -> None:
    append_log(log_row(spark, SEARCH_TAB, language, query, limit, start, now), path)


def log_discovery(spark: SparkSession, path: str, language: str, query: str,
                  now: _dt.datetime | None = None) -> None:
    append_log(log_row(spark, DISCOVERY_TAB, language, query, 30, 0, now), path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_LOG_SCHEMA).parquet(path)


def events_as_log(events: DataFrame, language: str = "english") -> DataFrame:
    """The driver's ``events`` table seen as a search log (test binding).

    ``event_type`` plays the tab, ``ts`` the time (kept as stored, so no
    session time zone applies), the ``k`` field of the JSON ``props`` the
    query text; limit and start are the search defaults (10, 1).
    """
    return events.select(F.col("event_type").alias("tab"), F.col("ts").alias("time"),
                         F.lit(language).alias("language"),
                         F.get_json_object("props", "$.k").alias("query"),
                         F.lit(10).alias("rows_returned_aka_limit"),
                         F.lit(1).alias("start_row_aka_offset"))


def log_stats(log: DataFrame) -> DataFrame:
    """Searches per tab, language and query, with first and last time."""
    return (log.groupBy("tab", "language", "query")
            .agg(F.count("*").alias("searches"), F.min("time").alias("first"),
                 F.max("time").alias("last")))


def compact_log(spark: SparkSession, path: str, out: str, files: int = 1) -> None:
    """Rewrite the log into at most ``files`` files per tab (small-file
    compaction); rows are dealt evenly, so no task takes a whole tab."""
    read_log(spark, path).repartition(files).write.mode("overwrite").partitionBy("tab").parquet(out)
