"""The driver's Parquet tables and the views derived from them.

``books`` binds the corpus model (num, author, language, title, length,
content) to the ``documents`` table. It is a projection only, so Catalyst
prunes ``text`` from every query that does not read ``content`` and pushes
filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LANGUAGE_CONFIGS
from .metadata import ARRAY_FIELDS, SCALAR_FIELDS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

# Fixed values of the test binding: language codes of `documents` -> names.
LANGUAGE_NAMES = (("en", "English"), ("fr", "French"), ("de", "German"),
                  ("es", "Spanish"))
# Fixed value of the test binding: the source whose books have no author.
NO_AUTHOR_SOURCE = "src0"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _language_name(code: Column) -> Column:
    expr = None
    for c, n in LANGUAGE_NAMES:
        expr = F.when(code == c, n) if expr is None else expr.when(code == c, n)
    return expr.otherwise(code)


def books_from_documents(documents: DataFrame) -> DataFrame:
    """``documents`` seen as the book table of the reference's data model."""
    return documents.select(
        F.col("doc_id").alias("num"),
        F.when(F.col("source") == NO_AUTHOR_SOURCE, F.lit(None).cast("string"))
        .otherwise(F.col("source")).alias("author"),
        _language_name(F.col("lang")).alias("language"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("n_chars").alias("length"),
        F.col("text").alias("content"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books_from_documents(read_table(spark, sf_dir, "documents"))


def configs(spark: SparkSession) -> DataFrame:
    """The catalogue of analyser names a book language can match."""
    return spark.createDataFrame([(n,) for n in LANGUAGE_CONFIGS], "cfgname string")


# Reference schemas (FIXTURES A), for empty typed tables and explicit reads.
METADATA_FIELDS = tuple(name for _, name in ARRAY_FIELDS + SCALAR_FIELDS)

METADATA_SCHEMA = T.StructType(
    [T.StructField("num", T.LongType())]
    + [T.StructField(f, T.StringType()) for f in METADATA_FIELDS])

CONTENT_SCHEMA = T.StructType([T.StructField("num", T.LongType()),
                               T.StructField("content", T.StringType())])

QUERY_LOG_SCHEMA = T.StructType([
    T.StructField("tab", T.StringType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("language", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("rows_returned_aka_limit", T.IntegerType()),
    T.StructField("start_row_aka_offset", T.IntegerType()),
])


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


__all__ = ["TABLES", "read_table", "books", "books_from_documents", "configs",
           "METADATA_FIELDS", "METADATA_SCHEMA",
           "CONTENT_SCHEMA", "QUERY_LOG_SCHEMA", "empty_table"]
