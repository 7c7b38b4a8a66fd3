"""The corpus build: books -> paragraphs -> postings -> mentions, written.

The reference runs each step by hand as a full materialisation
(lengths, book table, paragraphs, repair, vectors, index, language, mention
table). Here the steps between the written tables are fused by Catalyst:

1. ``books``: catalogue x content (lengths are a projection of the content,
   not a table of their own), written once;
2. ``paragraphs`` (+ language) and ``postings`` / ``lexeme_stats``:
   ``operators.postings.build_index``;
3. ``mentions``: the k-gram equi-join over the written paragraphs.

Every step reads the previous step's Parquet output, so a failure restarts
from the last written table rather than from the raw text.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mentions as MN
from ..operators.postings import build_index
from ..sources.sinks import write_table


def build_corpus(spark: SparkSession, books: DataFrame, names: DataFrame, path: str) -> dict[str, str]:
    """Write books, paragraphs, postings, lexeme_stats and mentions under ``path``."""
    out = {"books": os.path.join(path, "books")}
    write_table(books, out["books"])
    stored_books = spark.read.parquet(out["books"])
    out.update(build_index(spark, stored_books, path))
    paras = spark.read.parquet(out["paragraphs"]).where(F.col("language").isNotNull())
    pairs = MN.mention_pairs(names, paras, stored_books)
    out["mentions"] = os.path.join(path, "mentions")
    write_table(pairs, out["mentions"])
    return out
