"""Whole-text book files.

The reference pastes every file into the database through a generated shell
script, one book at a time. Here the files are read in parallel by Spark's
``binaryFile`` reader (compressed ones by its text reader, which knows the
codecs), matched to the catalogue by path, and written once to Parquet; nothing
is read through the driver. A ``Listing`` of a folder serves several steps.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .sinks import write_table


def path_part(path: Column, index: int, sep: str = "/") -> Column:
    """1-based element of ``path`` split on ``sep``; '' past the end, NULL-safe.

    ``split_part`` never raises under ANSI mode, unlike ``split(...)[i]``.
    """
    return F.split_part(path, F.lit(sep), F.lit(index))


def _root_path(root: str) -> str:
    """``root`` without scheme and authority, as file paths show it."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", root.rstrip("/")).rstrip("/")


def relative_path(file_path: Column, root: str) -> Column:
    """Plain path below ``root`` of a percent-encoded ``_metadata.file_path``.

    ``+`` is an ordinary character of a path, so it is kept from the decoder.
    """
    plain = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, r"^.*?" + _java_quote(_root_path(root)) + "/+", "")


def trimmed(content: Column) -> Column:
    """Without one trailing newline, as a shell read of the file drops it."""
    return F.regexp_replace(content, r"\n\z", "")


# Spark's readers take some 32 small files a task; so many such shares go to one task.
SHARES = 32


def _packed(files: DataFrame) -> DataFrame:
    """Many small files a task, whose start costs more than reading one."""
    shares = files.rdd.getNumPartitions()
    least = files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(2 * least, shares // SHARES)) if shares > 2 * least else files


class Listing(NamedTuple):
    """The files of a folder, listed by Spark once: ``files`` reads them, ``sizes``
    has ``rel_path, size`` of the non-empty ones."""
    files: DataFrame
    sizes: DataFrame


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def _sizes(files: DataFrame, root: str) -> DataFrame:
    return _packed(files.select(relative_path(F.col("_metadata.file_path"), root).alias("rel_path"),
                                F.col("_metadata.file_size").alias("size")))


def list_files(spark: SparkSession, root: str) -> Listing:
    """The listing of ``root`` as it is now, with its sizes written."""
    files = _files(spark, root)
    sizes = _sizes(files, root)
    return Listing(files, spark.read.schema(sizes.schema).parquet(write_table(sizes, scratch_path(spark, "listing"))))


def _codec_suffixes(spark: SparkSession) -> list[str]:
    """Name endings of the files that the text reader decompresses."""
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop
    kinds = hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    return [hadoop.util.ReflectionUtils.newInstance(k, conf).getDefaultExtension() for k in kinds] or [".gz", ".deflate"]


def book_files(spark: SparkSession, root: str, listing: Listing | None = None) -> DataFrame:
    """``rel_path, content`` of every non-empty file under ``root``."""
    path = F.col("_metadata.file_path")
    suffixes = _codec_suffixes(spark)
    packed = lambda c: F.coalesce(*(F.when(c.endswith(x), True) for x in suffixes), F.lit(False))
    files = listing.files if listing else _files(spark, root)
    files = _packed(files.select(relative_path(path, root).alias("rel_path"), F.col("content").cast("string").alias("content")))
    if listing and listing.sizes.where(packed(F.col("rel_path"))).isEmpty():
        return files
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{{{','.join(suffixes)}}}")
    texts = _packed(texts.select(relative_path(path, root).alias("rel_path"), F.col("value").alias("content")))
    return files.where(~packed(F.col("rel_path"))).unionByName(texts)


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path, size`` of every non-empty file under ``root``; no content is read."""
    return _sizes(_files(spark, root), root)


def write_book_files(books: DataFrame, root: str, folder_books: int) -> DataFrame:
    """Every book's text as a file of its own under ``root``, with a trailing
    newline; ``num, gd_path`` of the files, which are there once it is computed.

    A folder holds the books of ``folder_books`` consecutive numbers and one task
    writes it. Rows of one number are lines of one file.
    """
    num = F.col("num")
    folder = F.floor(num / folder_books).cast("string")
    whole = (books.withColumn("folder", F.coalesce(folder, F.lit("none"))).repartition("folder").groupBy("folder", "num")
             .agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("content", F.lit("")))), "\n").alias("content"))
             .select("num", F.concat("folder", F.lit("/"), F.coalesce(num.cast("string"), F.lit("none")), F.lit(".txt")).alias("gd_path"), "content"))

    def write(batches):
        target, base = fs.FileSystem.from_uri(root)
        made = set()
        for b in batches:
            for path, content in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                where = f"{base}/{path.rpartition('/')[0]}"
                if where not in made:
                    target.create_dir(where, recursive=True)
                    made.add(where)
                with target.open_output_stream(f"{base}/{path}") as out:
                    out.write(f"{content}\n".encode())
            yield b.select([0, 1])
    return whole.mapInArrow(write, "num long, gd_path string")


# So many paths (some 130 MB) are broadcast to the files, else the text would be
# shuffled; of more both sides are, however small Spark takes their table for.
MOST_PATHS = 1 << 20


def read_contents(spark: SparkSession, metadata: DataFrame, root: str,
                  path_col: str = "gd_path", listing: Listing | None = None) -> DataFrame:
    """``(num, content)`` for every catalogue row, from files under ``root``.

    - Files are matched on their path relative to ``root``. The text meets the
      catalogue in an inner join, whose small side is broadcast up to
      ``MOST_PATHS``, so the text isn't shuffled for it; catalogue rows without text are found by
      paths alone and get ''. ``content_report`` says why.
    - One trailing newline is dropped, as a shell read of the file does.
    """
    wanted = metadata.select("num", F.col(path_col).alias("rel_path"))
    few = wanted.count() <= MOST_PATHS
    files = book_files(spark, root, listing)
    sizes = listing.sizes if listing else file_sizes(spark, root)
    found = files.join(wanted.hint("broadcast" if few else "merge"), "rel_path").select("num", trimmed(F.col("content")).alias("content"))
    rest = wanted.join(sizes if few else sizes.hint("merge"), "rel_path", "left_anti").select("num", F.lit("").alias("content"))
    return found.unionByName(rest)


def empty_files(spark: SparkSession, root: str, listing: Listing | None = None) -> list[str]:
    """Relative paths of zero-byte files, which Spark's readers skip.

    When the file system counts as many files as the readers see, there are none;
    else a walk over its listing on the driver (the readers list there too), of
    which only the empty ones are kept.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getContentSummary(path).getFileCount() == (listing.sizes if listing else file_sizes(spark, root)).count():
        return []
    walk = system.listFiles(path, True)
    start, out = _root_path(root), []
    while walk.hasNext():
        f = walk.next()
        if f.getLen() == 0:
            name = f.getPath().toUri().getPath()
            out.append(name[name.index(start) + len(start):].lstrip("/"))
    return out


def content_report(spark: SparkSession, metadata: DataFrame, root: str,
                   path_col: str = "gd_path", listing: Listing | None = None) -> DataFrame:
    """``(num, rel_path, status)`` of what has no counterpart.

    ``missing``: the catalogue names a file that isn't there; ``empty``: it is
    there without a byte; ``unlisted``: no catalogue row names the file (null
    num). The listing reads paths and sizes, no content.
    """
    sizes = listing.sizes if listing else file_sizes(spark, root)
    if none := empty_files(spark, root, listing):
        sizes = sizes.unionByName(spark.createDataFrame([(p, 0) for p in none], "rel_path string, size long"))
    wanted = metadata.select("num", F.col(path_col).alias("rel_path"))
    both = wanted.withColumn("listed", F.lit(True)).join(sizes, "rel_path", "full")
    status = (F.when(F.col("listed").isNull(), "unlisted").when(F.col("size").isNull(), "missing")
              .when(F.col("size") == 0, "empty"))
    return both.select("num", "rel_path", status.alias("status")).where("status is not null")


def _java_quote(s: str) -> str:
    return r"\Q" + s + r"\E"
