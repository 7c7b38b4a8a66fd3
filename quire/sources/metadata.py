"""Book catalogue: a JSON array of records -> typed metadata columns.

The reference loads one file holding a JSON array, turns each element into a
row, then pulls 15 fields out by JSON path, taking element 0 of array-valued
fields and mapping the catalogue's unknown marker ``"?"`` to NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentinel_null

# Catalogue keys and the output column each one fills, in the
# catalogue's order. Keys of the first group hold arrays (element 0 is used);
# keys of the second group hold scalars.
ARRAY_FIELDS = (
    ("Author", "author"),
    ("Author Birth", "author_birth"),
    ("Author Death", "author_death"),
    ("Author Given", "author_given"),
    ("Author Surname", "author_surname"),
    ("Copyright Status", "copyright_status"),
    ("Language", "language"),
    ("LoC Class", "loc_class"),
    ("Subject", "subject"),
    ("Title", "title"),
)
SCALAR_FIELDS = (
    ("charset", "charset"),
    ("gd-num-padded", "gd_num_padded"),
    ("gd-path", "gd_path"),
    ("href", "href"),
)
NUM_KEY = "Num"
UNKNOWN = "?"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row ``metadata string`` per element of the JSON array in ``path``.

    The file is read whole (one record), parsed once, and exploded; the
    elements stay JSON text (schema-on-read) until ``flatten_metadata``.
    """
    raw = spark.read.text(path, wholetext=True)
    return explode_json_array(raw, "value").select("metadata")


def explode_json_array(df: DataFrame, column: str, out: str = "metadata") -> DataFrame:
    """One row per element of the JSON array held in ``column`` (text kept)."""
    return df.withColumn(out, F.explode(F.from_json(F.col(column), "array<string>")))


def _path(key: str, element0: bool) -> str:
    return f"$['{key}'][0]" if element0 else f"$['{key}']"


def flatten_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """The 15 typed catalogue columns (``num`` + 14 text fields).

    ``num`` uses ``try_cast`` so a malformed id gives NULL instead of failing
    the job under ANSI mode.
    """
    m = F.col(column)
    cols = [F.get_json_object(m, _path(NUM_KEY, False)).try_cast("bigint").alias("num")]
    for key, name in ARRAY_FIELDS:
        cols.append(sentinel_null(F.get_json_object(m, _path(key, True)), UNKNOWN).alias(name))
    for key, name in SCALAR_FIELDS:
        cols.append(sentinel_null(F.get_json_object(m, _path(key, False)), UNKNOWN).alias(name))
    return df.select(*cols)


def metadata_rejects(df: DataFrame, column: str = "metadata") -> DataFrame:
    """Catalogue records whose id is present but not an integer.

    ``flatten_metadata`` gives them a NULL ``num`` (``try_cast``) instead of
    failing the whole load; this lists them for review.
    """
    raw = F.get_json_object(F.col(column), _path(NUM_KEY, False))
    return (df.select(raw.alias("raw_num"), F.col(column))
            .where(F.col("raw_num").isNotNull() & F.col("raw_num").try_cast("bigint").isNull()))


def gd_num_padded(num: Column) -> Column:
    return F.lpad(num.cast("string"), 5, "0")


def gd_path(num: Column) -> Column:
    """Where the catalogue keeps a book's text: ``<first 3 digits>/<padded>.txt``."""
    p = gd_num_padded(num)
    return F.concat(F.substring(p, 1, 3), F.lit("/"), p, F.lit(".txt"))


CATALOGUE_BOOKS = 25


def catalogue_records(books: DataFrame, size: int = CATALOGUE_BOOKS) -> DataFrame:
    """Catalogue JSON in the shape the reference reads: ``part, catalogue``, one
    array for each ``size`` consecutive numbers, records by number.

    Unknown values are written as ``"?"``, as the catalogue does, so the
    flatten step exercises the sentinel mapping; years, given names and subjects
    are made of the number, some unknown.
    """
    q = F.lit(UNKNOWN)
    num = F.col("num")

    def year(first: int, every: int):
        return F.when(num % every == 0, q).otherwise((num % 150 + first).cast("string"))

    rec = F.struct(
        num.alias(NUM_KEY),
        F.array(F.coalesce(F.col("author"), q)).alias("Author"),
        F.array(year(1700, 3)).alias("Author Birth"),
        F.array(year(1760, 4)).alias("Author Death"),
        F.array(F.coalesce(F.col("author"), q), F.lit("second")).alias("Author Given"),
        F.array(F.when(num % 2 == 0, q).otherwise(F.concat(F.lit("S"), num.cast("string")))).alias("Author Surname"),
        F.array(F.lit("Public domain in the USA.")).alias("Copyright Status"),
        F.array(F.coalesce(F.col("language"), q)).alias("Language"),
        F.array(q).alias("LoC Class"),
        F.when(num % 5 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("topic "), (num % 7).cast("string")), F.lit("books"))).alias("Subject"),
        F.array(F.coalesce(F.col("title"), q)).alias("Title"),
        F.lit("utf-8").alias("charset"),
        gd_num_padded(num).alias("gd-num-padded"),
        gd_path(num).alias("gd-path"),
        F.concat(F.lit("/ebooks/"), num.cast("string")).alias("href"),
    )
    part = F.floor(num / size).alias("part")
    return (books.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(num.alias("n"), rec.alias("r")))).alias("rs"))
            .select("part", F.to_json(F.transform("rs", lambda x: x["r"])).alias("catalogue")))
