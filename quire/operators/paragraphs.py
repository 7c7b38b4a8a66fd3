"""Books -> paragraphs, the repair steps, and the length audit.

Split rule (the reference's code): the content is cut at every period
followed by a newline; the delimiter is consumed and empty parts are kept.
Each paragraph keeps its ordinal ``para`` in the book, so equal paragraphs of
one book stay distinct rows and every later table has the key (num, para).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LANGUAGE_CONFIGS, language_config

# Fixed value: the paragraph delimiter of the reference (period + newline).
PARAGRAPH_DELIMITER = ".\n"


def _java_literal(delim: str) -> str:
    return r"\Q" + delim + r"\E"


def split_parts(text: Column, delimiter: str = PARAGRAPH_DELIMITER) -> Column:
    """Array of parts of ``text`` cut at ``delimiter`` (literal), empties kept."""
    return F.split(text, _java_literal(delimiter), -1)


def split_paragraphs(books: DataFrame, delimiter: str = PARAGRAPH_DELIMITER,
                     keep: Iterable[str] = ("num",)) -> DataFrame:
    """``keep..., para, paragraph, paragraph_length`` per paragraph.

    Empty or NULL content gives no rows (the reference's ``unnest`` of an
    empty array). The split is a narrow, per-row generator: no shuffle, and
    a filter on a kept column (e.g. language) is pushed below it into the scan.
    """
    keep = list(keep)
    return (books
            .where(F.col("content").isNotNull() & (F.length("content") > 0))
            .select(*keep, F.posexplode(split_parts(F.col("content"), delimiter))
                    .alias("para", "paragraph"))
            .withColumn("paragraph_length", F.length("paragraph")))


def book_paragraphs(books: DataFrame, catalogue=LANGUAGE_CONFIGS) -> DataFrame:
    """Paragraphs with the analyser name denormalised onto them.

    The reference fills the paragraph's language by an update joined to the
    books (``lower(language) = cfgname``). The language is a column of the
    book row being split, so here it is carried through the split instead:
    the same value, without a join.
    """
    return split_paragraphs(
        books.select("num", "content", language_config(F.col("language"), catalogue).alias("language")),
        keep=("num", "language"))


def attach_language(paragraphs: DataFrame, books: DataFrame) -> DataFrame:
    """Update-from-join: set ``language`` where the book's language has an
    analyser, NULL otherwise (rows without a match stay, as in an UPDATE).

    ``books`` is projected to (num, language) before the join so the content
    never enters the shuffle; AQE broadcasts that side when it is small.
    """
    cfg = books.select("num", language_config(F.col("language")).alias("language"))
    base = paragraphs.drop("language") if "language" in paragraphs.columns else paragraphs
    return base.join(cfg, on="num", how="left")


def resplit_long(paragraphs: DataFrame, max_length: int, delimiter: str = "\n",
                 nums: Iterable[int] | None = None) -> DataFrame:
    """Re-split paragraphs longer than ``max_length`` on a second delimiter.

    The reference re-splits the paragraphs of a literal list of books on the
    *same* delimiter, which only duplicates them (SURVEY D3). This is the
    useful form: a paragraph over the limit (optionally only for the books in
    ``nums``) is replaced by its parts on ``delimiter``; others pass as one
    part. ``part`` numbers the pieces inside the paragraph.
    """
    too_long = F.col("paragraph_length") > max_length
    if nums is not None:
        too_long = too_long & F.col("num").isin(list(nums))
    parts = F.when(too_long, split_parts(F.col("paragraph"), delimiter)) \
        .otherwise(F.array(F.col("paragraph")))
    cols = [c for c in paragraphs.columns if c not in ("paragraph", "paragraph_length")]
    return (paragraphs
            .select(*cols, F.posexplode(parts).alias("part", "paragraph"))
            .withColumn("paragraph_length", F.length("paragraph")))


def new_parts(paragraphs: DataFrame, max_length: int, delimiter: str = "\n",
              nums: Iterable[int] | None = None) -> DataFrame:
    """The rows an insert adds: the parts, on ``delimiter``, of paragraphs longer
    than ``max_length`` (of the listed books). The old rows stay until
    ``prune_long`` deletes what is too long."""
    too_long = F.col("paragraph_length") > max_length
    if nums is not None:
        too_long = too_long & F.col("num").isin(list(nums))
    cols = [c for c in paragraphs.columns if c not in ("paragraph", "paragraph_length")]
    return (paragraphs.where(too_long)
            .select(*cols, F.explode(split_parts(F.col("paragraph"), delimiter)).alias("paragraph"))
            .withColumn("paragraph_length", F.length("paragraph")))


def prune_long(paragraphs: DataFrame, max_length: int) -> DataFrame:
    """``DELETE WHERE paragraph_length > max_length``: a NULL length stays."""
    return paragraphs.where(~F.coalesce(F.col("paragraph_length") > max_length, F.lit(False)))


def language_bucket(language: Column) -> Column:
    """English / French / German, everything else (NULL included) -> Other."""
    return F.when(language.isin("English", "French", "German"), language).otherwise("Other")


def longest_paragraphs(paragraphs: DataFrame, books: DataFrame, n: int = 30) -> DataFrame:
    """The audit query: the ``n`` longest non-empty paragraphs with their book.

    Top-k: the limit is the feature. Spark plans ``TakeOrderedAndProject``,
    a per-partition top-n then a merge of n rows per partition.
    """
    meta = books.select("num", "title", "language")
    return (paragraphs.where(F.col("paragraph_length") != 0)
            .select("num", "para", "paragraph_length")
            .join(meta, on="num")
            .select("num", "para", "title", "language",
                    language_bucket(F.col("language")).alias("language_bucket"),
                    "paragraph_length")
            .orderBy(F.col("paragraph_length").desc(), F.col("num"), F.col("para"))
            .limit(n))
