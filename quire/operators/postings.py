"""The inverted index, re-aimed as a dataset.

``postings`` (as a query): one row per (language, lexeme, num, para) with
the sorted positions and the term frequency -- the lexeme vector of a
paragraph, grouped by lexeme. The stored index keeps one row per position
instead (no aggregation to build it; sorted runs compress well), written as
``language=<cfg>/bucket=<hash(lexeme) % B>/``, each file sorted by lexeme, so:

- a search opens only its language's and lexemes' bucket directories;
- ``lexeme IN (...)`` then skips row groups by their min/max statistics;
- a bucket's files follow its size (rebalanced partitions), so one very
  frequent lexeme is spread over several.

The paragraphs are stored as ``language=<cfg>/block=<hash(num) % P>/``: the text
of a result page is read from its books' blocks.

``lexeme_stats``: per (language, lexeme) the number of paragraphs containing
it and the number of occurrences; small, used to order query terms.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import (LANGUAGE_CONFIGS, WORD_PATTERN, spark_sql_str, sql_known_word,
                              sql_lexeme_by_language, sql_stem_by_language)
from ..sources.sinks import concurrent_files, write_table
from .analysis import analyze, normalize_with_dictionary
from .matching import with_once
from .paragraphs import book_paragraphs
from .vocabulary import analyze_stemmed, build_dictionary, vocabulary


# Characters of text per lexeme bucket and per paragraph block, and the most
# directories of either kind per language.
LAYOUT_CHARS = 8 << 20
MAX_BUCKETS = 4096
# Files of different buckets that one task may have open.
OPEN_FILES = 32
# Positions between the two lexemes of a pair, at most.
PAIR_GAP = 2
# The stored tables.
POSITIONS = "num long, para int, ti int, lexeme string, language string, bucket int"
SCHEMAS = {"paragraphs": "num long, para int, paragraph string, paragraph_length int, language string, block int",
           "postings": POSITIONS, "lexeme_stats": "lexeme string, paragraphs long, occurrences long, language string"}
LAYOUT = "buckets int, blocks int, stemmed boolean, pairs boolean"


def default_layout(chars: int) -> int:
    """Buckets (and blocks) for a corpus of so many characters."""
    return max(1, min(MAX_BUCKETS, -(-chars // LAYOUT_CHARS)))


def lexeme_bucket(lexeme, buckets: int):
    """Bucket of a lexeme (column or literal): ``pmod(xxhash64(lexeme), buckets)``."""
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def postings(analyzed: DataFrame, extra_keys=()) -> DataFrame:
    """``language, lexeme, num, para, tf, positions`` from ``analyze`` rows."""
    return (analyzed.groupBy(*extra_keys, "language", "lexeme", "num", "para")
            .agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("ti")).alias("positions")))


def lexeme_stats(post: DataFrame) -> DataFrame:
    """``language, lexeme, paragraphs, occurrences`` from grouped postings."""
    return (post.groupBy("language", "lexeme")
            .agg(F.count("*").alias("paragraphs"), F.sum("tf").alias("occurrences")))


def paragraph_stats(paragraphs: DataFrame, catalogue=LANGUAGE_CONFIGS, dictionary: DataFrame | None = None) -> DataFrame:
    """``lexeme_stats`` straight from the paragraphs.

    A paragraph sits in one row, so its repeats are seen there: its sorted
    lexemes are exploded with a flag on the first of each, and both counts are
    one partial aggregate by (language, lexeme). No position is shuffled.
    With ``dictionary`` lexemes may fall together after the look-up, so the
    analysed rows are reduced by paragraph first.
    """
    if dictionary is not None:
        return reduced_stats(normalize_with_dictionary(analyze(paragraphs, catalogue), dictionary))
    words = paragraphs.where(F.col("language").isNotNull()).select("language", "paragraph")
    # words are lower-cased once; sort_array compares strings without a lambda
    lexemes = F.expr(f"sort_array(transform(filter(transform(regexp_extract_all(paragraph, {spark_sql_str(WORD_PATTERN)}, 0), "
                     f"t -> lower(t)), w -> {sql_known_word('w', 'language', catalogue)}), "
                     f"w -> {sql_stem_by_language('w', 'language', catalogue)}))")
    rows = with_once(words, lx=lexemes).select(
        "language", F.expr("inline(transform(lx, (x, i) -> struct(x AS lexeme, i = 0 OR lx[i - 1] <> x AS first)))"))
    return rows.groupBy("language", "lexeme").agg(F.count_if("first").alias("paragraphs"),
                                                  F.count("*").alias("occurrences"))


def reduced_stats(analyzed: DataFrame) -> DataFrame:
    """``lexeme_stats`` of analysed rows, reduced by paragraph first."""
    return lexeme_stats(analyzed.groupBy("language", "lexeme", "num", "para").agg(F.count("*").alias("tf")))


def build_index(spark: SparkSession, books: DataFrame, path: str, buckets: int | None = None,
                blocks: int | None = None, catalogue=LANGUAGE_CONFIGS,
                dictionary: DataFrame | None = None, stemmed: bool = False,
                pair_share: float | None = None) -> dict[str, str]:
    """Write ``paragraphs``, ``postings``, ``lexeme_stats`` and ``layout`` under ``path``.

    The paragraph table is written once and the postings are derived from the
    written table (not from the books again), so the split runs once and the
    lineage of the postings job starts at Parquet. Buckets and blocks follow
    from the characters of the books. One shuffle, one sort, no aggregation
    for the postings; the statistics read the paragraphs. ``catalogue`` names
    the analysers; ``dictionary`` is the optional normaliser (bind queries
    with the same one). ``stemmed``: the vocabulary of the stored paragraphs is
    stemmed once into a ``dictionary`` table, which gives the postings their
    lexemes and queries over the index their forms. ``pair_share``: lexemes in
    at least this share of their language's paragraphs are ``frequent``, and
    every two of them at most ``PAIR_GAP`` positions apart are a row of ``pairs``,
    so a phrase of common words reads the short lists of its pairs.
    """
    size = F.col("length") if "length" in books.columns else F.length("content")
    layout = default_layout(books.agg(F.sum(size)).first()[0] or 0)
    return write_index(spark, book_paragraphs(books, catalogue), path, buckets or layout, blocks or layout, catalogue,
                       dictionary, stemmed, pair_share)


def write_index(spark: SparkSession, paragraphs: DataFrame, path: str, buckets: int, blocks: int,
                catalogue=LANGUAGE_CONFIGS, dictionary: DataFrame | None = None, stemmed: bool = False,
                pair_share: float | None = None) -> dict[str, str]:
    """``build_index`` of paragraphs ``num, para, language, paragraph, ...``."""
    if pair_share and (stemmed or dictionary is not None):
        raise ValueError("pairs are of the analysers' own lexemes")
    out = write_tables(spark, paragraphs, path, buckets, blocks, catalogue, dictionary, stemmed)
    out["layout"] = os.path.join(path, "layout")
    if pair_share:
        stored = spark.read.parquet(out["paragraphs"])
        number = stored.where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("of"))
        stats = spark.read.parquet(out["lexeme_stats"]).join(number, "language")
        write_table(stats.where(F.col("paragraphs") >= pair_share * F.col("of")).select("language", "lexeme"), os.path.join(path, "frequent"))
        write_pairs(stored, path, frequent_lexemes(spark, path), buckets, catalogue)
    spark.createDataFrame([], "segment int, kind string").write.mode("overwrite").parquet(os.path.join(path, "manifest"))
    (spark.createDataFrame([(buckets, blocks, stemmed, bool(pair_share))], LAYOUT)
     .coalesce(1).write.mode("overwrite").parquet(out["layout"]))
    return out


def write_tables(spark: SparkSession, paragraphs: DataFrame, path: str, buckets: int, blocks: int, catalogue=LANGUAGE_CONFIGS,
                 dictionary: DataFrame | None = None, stemmed: bool = False) -> dict[str, str]:
    """``paragraphs``, ``postings`` and ``lexeme_stats`` (and ``dictionary``) under ``path``."""
    out = {k: os.path.join(path, k) for k in ("paragraphs", "postings", "lexeme_stats")}
    paras = paragraphs.withColumn("block", book_block(F.col("num"), blocks))
    write_table(paras.hint("rebalance", "language", "block"), out["paragraphs"], partition_by=["language", "block"],
                sort_within=["language", "block", "num", "para"])
    stored = spark.read.schema(paras.schema).parquet(out["paragraphs"])
    if stemmed:
        words = spark.read.parquet(write_table(vocabulary(stored, catalogue), os.path.join(path, "vocabulary")))
        write_table(build_dictionary(words, catalogue), os.path.join(path, "dictionary"))
        analyzed = analyze_stemmed(stored, spark.read.parquet(os.path.join(path, "dictionary")), catalogue)
    else:
        analyzed = analyze(stored, catalogue)
    if dictionary is not None:
        analyzed = normalize_with_dictionary(analyzed, dictionary)
    # one row per position: Parquet's dictionary / run-length encoding stores
    # the sorted repeated (lexeme, num, para) keys compactly
    _write_positions(analyzed, out["postings"], buckets)
    stats = reduced_stats(analyzed) if stemmed else paragraph_stats(stored, catalogue, dictionary)
    write_table(stats, out["lexeme_stats"], partition_by=["language"])
    return out


def _write_positions(rows: DataFrame, path: str, buckets: int) -> None:
    keyed = rows.withColumn("bucket", lexeme_bucket(F.col("lexeme"), buckets))
    # a task holds few buckets, each a file open at once: rows are sorted by lexeme
    # first, which tells most of them apart, not by directory, which tells few
    with concurrent_files(rows.sparkSession, OPEN_FILES):
        write_table(keyed.hint("rebalance", "language", "bucket"), path, partition_by=["language", "bucket"],
                    sort_within=["lexeme", "num", "para", "ti"])


def pair_key(a: str, b: str, gap: int) -> str:
    """The pair list of ``a`` and, ``gap`` positions on, ``b`` (a lexeme has no space)."""
    return f"{a} {b} {gap}"


def frequent_lexemes(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The frequent lexemes by language: at most the lexemes of an average
    paragraph divided by the share, so a few thousand."""
    out: dict[str, list[str]] = {}
    for r in spark.read.parquet(os.path.join(path, "frequent")).orderBy("language", "lexeme").collect():
        out.setdefault(r["language"], []).append(r["lexeme"])
    return out


def write_pairs(stored: DataFrame, path: str, frequent: dict[str, list[str]], buckets: int, catalogue=LANGUAGE_CONFIGS) -> None:
    """``pairs`` under ``path``, laid out like the postings, from stored paragraphs."""
    known = " OR ".join(f"(language = {spark_sql_str(n)} AND x IN ({', '.join(map(spark_sql_str, lx))}))" for n, lx in frequent.items()) or "false"
    lexemes = (f"transform(transform(regexp_extract_all(paragraph, {spark_sql_str(WORD_PATTERN)}, 0), "
               f"t -> {sql_lexeme_by_language('t', 'language', catalogue)}), x -> IF({known}, x, NULL))")
    words = stored.where(F.col("language").isNotNull()).select("language", "num", "para", "paragraph")
    keys = ", ".join(f"named_struct('ti', i, 'lexeme', concat(x, ' ', get(lx, i + {gap}), ' {gap}'))" for gap in range(1, PAIR_GAP + 1))
    pairs = f"filter(flatten(transform(lx, (x, i) -> array({keys}))), p -> p.lexeme IS NOT NULL)"
    rows = with_once(words, lx=F.expr(lexemes)).select("language", "num", "para", F.inline(F.expr(pairs)))
    _write_positions(rows, os.path.join(path, "pairs"), buckets)


def book_block(num, blocks: int):
    """Block of a book's paragraphs: ``pmod(xxhash64(num), blocks)``."""
    return F.pmod(F.xxhash64(num), F.lit(blocks)).cast("int")


def read_index(spark: SparkSession, path: str) -> dict:
    """The index tables (a ``dictionary`` if it was built ``stemmed``, the
    ``frequent`` lexemes if it has pairs), ``buckets`` and ``blocks`` from its
    layout and its ``path``; with what was appended and without what was deleted
    since (``operators.segments``)."""
    from .segments import live_tables

    # known schemas: opening an index reads no file footers
    idx = {k: spark.read.schema(schema).parquet(os.path.join(path, k)) for k, schema in SCHEMAS.items()}
    layout = spark.read.schema(LAYOUT).parquet(os.path.join(path, "layout")).first()
    if layout["stemmed"]:
        idx["dictionary"] = spark.read.parquet(os.path.join(path, "dictionary"))
    if layout["pairs"]:
        idx["frequent"] = frequent_lexemes(spark, path)
    return live_tables(spark, idx | {"buckets": layout["buckets"], "blocks": layout["blocks"], "path": path})


def open_postings(spark: SparkSession, path: str, language: str, lexemes, buckets: int, table: str = "postings") -> DataFrame:
    """The postings of ``lexemes`` (or the ``pairs`` of pair keys), listing only
    their bucket directories.

    The buckets are computed on an inline table (no job). A language or bucket
    that isn't there gives an empty table.
    """
    base = os.path.join(path, table)
    values = ", ".join(f"({spark_sql_str(lx)})" for lx in lexemes)
    rows = spark.sql(f"SELECT x FROM VALUES {values} AS v(x)").select(lexeme_bucket(F.col("x"), buckets)).collect()
    names = ",".join(sorted({str(r[0]) for r in rows}))
    try:
        got = (spark.read.option("basePath", base).schema(POSITIONS)
               .parquet(os.path.join(base, f"language={language}", f"bucket={{{names}}}")))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POSITIONS)
    return got.where(F.col("lexeme").isin(list(lexemes)))


def lexeme_filter(postings: DataFrame, language: str, lexemes, buckets: int | None = None):
    """Filter on the analyser and the lexemes, with bucket pruning when known.

    ``bucket IN (pmod(xxhash64('w'), B), ...)`` is constant-folded, so the scan
    lists only those bucket directories.
    """
    lexemes = list(lexemes)
    cond = (F.col("language") == language) & F.col("lexeme").isin(lexemes)
    if buckets and "bucket" in postings.columns:
        cond = cond & F.col("bucket").isin([lexeme_bucket(F.lit(lx), buckets) for lx in lexemes])
    return cond
