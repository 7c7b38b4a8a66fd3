"""An index that follows its text: appended segments, deletions, and their merge.

A built index stays as it is. New paragraphs become a *segment*, a folder with
the same tables, numbered in a ``manifest``; deleted ones a table of keys with a
number of their own, which hides rows of smaller numbers. Readers take all
segments together and drop hidden rows by an anti join on ``(num, para)``; the
statistics of deleted paragraphs are stored negative, so sums stay exact. A
change costs its own text, not the corpus. ``merge_index`` writes what is live
into a new index when the segments have become many.

One writer at a time; a reader sees what the manifest listed when it opened.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LANGUAGE_CONFIGS
from ..sources.sinks import write_table
from . import postings as P

ADDED, DELETED = "added", "deleted"


def _manifest(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    rows = spark.read.schema("segment int, kind string").parquet(os.path.join(path, "manifest"))
    return sorted((r["segment"], r["kind"]) for r in rows.collect())


def _folder(path: str, segment: int) -> str:
    return os.path.join(path, "segments", str(segment))


def _record(spark: SparkSession, path: str, segment: int, kind: str) -> int:
    spark.createDataFrame([(segment, kind)], "segment int, kind string").coalesce(1).write.mode("append").parquet(os.path.join(path, "manifest"))
    return segment


def _hide(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Rows (with their ``segment``) that no later deletion names."""
    if gone is None:
        return rows.drop("segment")
    later = ((rows["num"] == gone["num"]) & (rows["para"] == gone["para"]) & (gone["gone_by"] > rows["segment"]))
    return rows.join(gone, later, "left_anti").drop("segment")


def live_tables(spark: SparkSession, idx: dict) -> dict:
    """The tables of an opened base with all its segments; ``open`` reads lists."""
    path, manifest = idx["path"], _manifest(spark, idx["path"])

    def base_lists(language, lexemes, table="postings"):
        return P.open_postings(spark, path, language, lexemes, idx["buckets"], table)

    if not manifest:
        return idx | {"open": base_lists}
    gone = None
    for n, kind in manifest:
        if kind == DELETED:
            keys = spark.read.parquet(os.path.join(_folder(path, n), "deleted")).withColumn("gone_by", F.lit(n))
            gone = keys if gone is None else gone.unionByName(keys)
    added = [n for n, kind in manifest if kind == ADDED]

    def all_of(table):
        rows = idx[table].withColumn("segment", F.lit(0))
        for n in added:
            rows = rows.unionByName(spark.read.schema(idx[table].schema).parquet(os.path.join(_folder(path, n), table)).withColumn("segment", F.lit(n)))
        return rows

    def lists(language, lexemes, table="postings"):
        rows = base_lists(language, lexemes, table).withColumn("segment", F.lit(0))
        for n in added:
            more = P.open_postings(spark, _folder(path, n), language, lexemes, idx["buckets"], table)
            rows = rows.unionByName(more.withColumn("segment", F.lit(n)))
        return _hide(rows, gone)

    stats = idx["lexeme_stats"]
    for n, _ in manifest:
        stats = stats.unionByName(spark.read.schema(idx["lexeme_stats"].schema).parquet(os.path.join(_folder(path, n), "lexeme_stats")))
    stats = (stats.groupBy("language", "lexeme").agg(F.sum("paragraphs").alias("paragraphs"), F.sum("occurrences").alias("occurrences"))
             .where("paragraphs > 0"))
    out = idx | {"paragraphs": _hide(all_of("paragraphs"), gone), "postings": _hide(all_of("postings"), gone),
                 "lexeme_stats": stats.select(idx["lexeme_stats"].columns), "open": lists}
    for n in added if "dictionary" in idx else ():
        more = spark.read.schema(idx["dictionary"].schema).parquet(os.path.join(_folder(path, n), "dictionary"))
        out["dictionary"] = out["dictionary"].unionByName(more)
    return out


def append_paragraphs(spark: SparkSession, path: str, paragraphs: DataFrame, catalogue=LANGUAGE_CONFIGS) -> int:
    """Add paragraphs ``num, para, language, paragraph, paragraph_length`` (keys
    not in use); the number of their segment."""
    idx = P.read_index(spark, path)
    n = max((m[0] for m in _manifest(spark, path)), default=0) + 1
    into = _folder(path, n)
    out = P.write_tables(spark, paragraphs, into, idx["buckets"], idx["blocks"], catalogue, stemmed="dictionary" in idx)
    if "frequent" in idx:
        P.write_pairs(spark.read.schema(idx["paragraphs"].schema).parquet(out["paragraphs"]), into, idx["frequent"], idx["buckets"], catalogue)
    return _record(spark, path, n, ADDED)


def delete_paragraphs(spark: SparkSession, path: str, keys: DataFrame, catalogue=LANGUAGE_CONFIGS) -> int:
    """Hide the paragraphs of ``keys`` (``num, para``); the number of the deletion."""
    idx = P.read_index(spark, path)
    n = max((m[0] for m in _manifest(spark, path)), default=0) + 1
    into = _folder(path, n)
    gone = spark.read.parquet(write_table(keys.select("num", "para").distinct(), os.path.join(into, "deleted")))
    lost = idx["paragraphs"].join(gone, ["num", "para"], "left_semi")
    if "dictionary" in idx:
        words = idx["dictionary"].dropDuplicates(["language", "word"])
        stats = P.reduced_stats(P.analyze_stemmed(lost, words, catalogue))
    else:
        stats = P.paragraph_stats(lost, catalogue)
    less = stats.select("language", "lexeme", (-F.col("paragraphs")).alias("paragraphs"), (-F.col("occurrences")).alias("occurrences"))
    write_table(less, os.path.join(into, "lexeme_stats"), partition_by=["language"])
    return _record(spark, path, n, DELETED)


def merge_index(spark: SparkSession, path: str, out: str, pair_share: float | None = None, catalogue=LANGUAGE_CONFIGS) -> dict[str, str]:
    """What is live in the index at ``path`` as a new index at ``out``."""
    idx = P.read_index(spark, path)
    live = idx["paragraphs"].drop("block")
    layout = P.default_layout(live.agg(F.sum("paragraph_length")).first()[0] or 0)
    return P.write_index(spark, live, out, layout, layout, catalogue, stemmed="dictionary" in idx, pair_share=pair_share)
