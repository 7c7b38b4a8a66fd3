"""Incremental ingest of book files with Structured Streaming.

The reference loads books by replaying a generated script, one file at a
time, into a table. Here new text files dropped under a folder are picked
up by a file stream (``wholetext``: one row per file), matched to the
catalogue by path, split into paragraphs and appended to the paragraph
table. ``trigger(availableNow=True)`` processes everything present and
stops, so the same job serves as a restartable batch load: the checkpoint
records which files were done, and a restart after a lost executor or
driver resumes there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paragraphs import book_paragraphs
from ..sources.files import relative_path, trimmed


def book_file_stream(spark: SparkSession, root: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming ``rel_path, content`` for files under ``root``."""
    root = root.rstrip("/")
    s = (spark.readStream.format("text").option("wholetext", True)
         .option("maxFilesPerTrigger", max_files_per_trigger)
         .option("recursiveFileLookup", True)
         .load(root))
    return s.select(relative_path(F.col("_metadata.file_path"), root).alias("rel_path"),
                    trimmed(F.col("value")).alias("content"))


def ingest_books(spark: SparkSession, root: str, metadata: DataFrame, out: str,
                 checkpoint: str, path_col: str = "gd_path"):
    """Start the stream: files -> books (catalogue join) -> paragraphs -> ``out``.

    ``metadata`` is a static DataFrame ``num, language, <path_col>``; the
    stream-static outer join attaches each file to its book; paragraphs of a
    file that no catalogue row names keep a NULL num (``content_report`` lists
    such files, missing ones and empty ones, which give no paragraphs). Returns
    the query handle (call ``awaitTermination()``).
    """
    meta = metadata.select("num", "language", F.col(path_col).alias("rel_path"))
    books = book_file_stream(spark, root).join(meta, "rel_path", "left")
    paras = book_paragraphs(books)
    return (paras.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint)
            .partitionBy("language").outputMode("append")
            .trigger(availableNow=True).start())
