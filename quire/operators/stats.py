"""Corpus statistics: languages, support, length histogram, summaries.

All are single aggregations over the book table with ``content`` pruned
(only ``num, language, author, length`` are read). The analyser catalogue
is a fixed list of three names, so membership is an ``IN`` over literals,
and the reference's ``IN (subquery)`` / ``NOT IN (subquery)`` become a
semi join / a null-aware anti join against a broadcast literal table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LANGUAGE_CONFIGS
from ..sources.tables import configs
from .paragraphs import language_bucket


def _supported(spark: SparkSession, books: DataFrame) -> DataFrame:
    cfg = F.broadcast(configs(spark))
    return books.join(cfg, F.lower(books["language"]) == cfg["cfgname"], "left_semi")


def supported_languages(spark: SparkSession, books: DataFrame) -> DataFrame:
    """Distinct languages with an analyser, ascending."""
    return (_supported(spark, books).select("language").distinct()
            .orderBy(F.col("language").asc_nulls_last()))


def supported_authors(spark: SparkSession, books: DataFrame) -> DataFrame:
    """Distinct authors of books in a supported language, ascending (NULL last)."""
    return (_supported(spark, books).select("author").distinct()
            .orderBy(F.col("author").asc_nulls_last()))


def unsupported_languages(spark: SparkSession, books: DataFrame) -> DataFrame:
    """One row: the languages without an analyser, sorted, comma-separated.

    ``lower(language) NOT IN (catalogue)``: a NULL language is neither in nor
    out, so it drops out (null-aware anti join). The distinct set of
    languages is small, so the final single-group string aggregate is too.
    """
    cfg = F.broadcast(configs(spark))
    langs = (books.where(F.col("language").isNotNull())
             .join(cfg, F.lower(books["language"]) == cfg["cfgname"], "left_anti")
             .select("language").distinct())
    return langs.agg(F.array_join(F.array_sort(F.collect_list("language")), ", ").alias("languages"))


def supported_flag(language) -> F.Column:
    return F.when(F.lower(language).isin(list(LANGUAGE_CONFIGS)), "Yes").otherwise("No")


def books_per_language(books: DataFrame) -> DataFrame:
    """``language, books, supported`` ordered by books desc, supported desc, language."""
    return (books.where(F.col("language").isNotNull())
            .groupBy("language")
            .agg(F.count("*").alias("books"))
            .withColumn("supported", supported_flag(F.col("language")))
            .orderBy(F.col("books").desc(), F.col("supported").desc(), F.col("language").asc()))


def books_by_support(books: DataFrame) -> DataFrame:
    """The two series of the language chart: supported and unsupported."""
    per = books_per_language(books)
    # The series labels of the reference's chart.
    label = F.when(F.col("supported") == "Yes", "Supported languages").otherwise("Unsupported languages")
    return per.select(label.alias("series"), "language", "books")


def bucketed_lengths(books: DataFrame) -> DataFrame:
    """``num, language, length`` for non-empty books, language bucketed."""
    return (books.where(F.col("length") != 0)
            .select("num", language_bucket(F.col("language")).alias("language"), "length"))


def book_length_hist(books: DataFrame, width: float = 0.25) -> DataFrame:
    """Histogram of log10(length) per language bucket, bins of ``width``."""
    b = bucketed_lengths(books)
    bin_ = F.floor(F.log10(F.col("length")) / F.lit(width)).cast("bigint")
    return (b.groupBy("language", bin_.alias("bin")).agg(F.count("*").alias("books"))
            .withColumn("bin_start", F.col("bin") * F.lit(width)))


def corpus_summary(books: DataFrame) -> DataFrame:
    """Books, unsupported-language share, share without author (one row)."""
    unsupported = ~F.coalesce(F.lower(F.col("language")).isin(list(LANGUAGE_CONFIGS)), F.lit(False))
    agg = books.agg(F.count("*").alias("books"),
                    F.count_if(unsupported).alias("unsupported_books"),
                    F.count_if(F.col("author").isNull()).alias("books_without_author"))
    return agg.select("*",
                      F.round(100 * F.col("unsupported_books") / F.col("books"), 1).alias("unsupported_pct"),
                      F.round(100 * F.col("books_without_author") / F.col("books"), 1).alias("without_author_pct"))


def catalogue_summary(metadata: DataFrame) -> DataFrame:
    """Catalogue rows and the share without the author's birth and death years (one row)."""
    none = F.col("author_birth").isNull() & F.col("author_death").isNull()
    agg = metadata.agg(F.count("*").alias("books"), F.count_if(none).alias("books_without_years"))
    return agg.select("*", F.round(100 * F.col("books_without_years") / F.col("books"), 1).alias("without_years_pct"))


def paragraph_summary(paragraphs: DataFrame) -> DataFrame:
    """Number of paragraphs, total and maximum length (one row)."""
    return paragraphs.agg(F.count("*").alias("paragraphs"),
                          F.sum("paragraph_length").alias("total_length"),
                          F.max("paragraph_length").alias("max_length"))
