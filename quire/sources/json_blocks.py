"""One JSON array of any size, read in byte ranges.

The text reader cuts a file into splits and reads, of every split, the pieces up
to each ``}`` that begin in it; a split and its pieces are a *block*. Where an
element of the outer array ends depends on what came before: whether a block
begins inside a string, and how deep in brackets. Both are a function of the
same two facts at the block's beginning, so

1. every block tells what it does to them, for a beginning outside and inside a
   string (one row a block);
2. the rows of a file are folded in order into the facts each block begins with;
3. every block is read once more, now knowing them, and cut at the commas of the
   outer array. An element that runs over the end of a block is put together
   from its fragments.

No file, array or block is ever one row; a task holds one element at a time, and
reads several blocks one after the other where they are small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OUTSIDE = re.compile(r'["\[\]{},]')
_INSIDE = re.compile(r'\\.|"', re.S)


def structure(text: str, inside: bool) -> Iterator[tuple[int, str]]:
    """Places and signs of the structure (brackets and commas outside strings),
    last ``(length, '"')`` if the text ends inside a string, else ``(length, '')``."""
    at = 0
    while True:
        m = (_INSIDE if inside else _OUTSIDE).search(text, at)
        if m is None:
            yield len(text), '"' if inside else ""
            return
        at = m.end()
        if m[0] == '"':
            inside = not inside
        elif not inside:
            yield m.start(), m[0]


# Bytes one task reads when the splits are smaller: it takes several of them in turn.
TASK_BYTES = 4 << 20


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, value``; many small blocks share a task, each still a block."""
    pieces = (spark.read.option("lineSep", "}").text(path)
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))
    blocks = pieces.rdd.getNumPartitions()
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return pieces.coalesce(max(spark.sparkContext.defaultParallelism, -(-blocks * split // TASK_BYTES)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    """(file, block, text) piece by piece; the reader has taken the ``}`` away.
    One that a file never had comes after its array and is ignored there."""
    for b in batches:
        for file, block, value in zip(*(c.to_pylist() for c in b.columns)):
            yield file, block, value + "}"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, and for a beginning outside and inside a string: inside at
    the end, change of depth)."""
    def row(key, state):
        return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "out_in": state[0][0], "out_depth": state[0][1],
                                            "in_in": state[1][0], "in_depth": state[1][1]}], _EFFECTS)

    now, state = None, []
    for file, block, text in _blocks(batches):
        if (file, block) != now:
            if now is not None:
                yield row(now, state)
            now, state = (file, block), [[False, 0], [True, 0]]
        for s in state:
            for _, sign in structure(text, s[0]):
                s[1] += (sign in ("[", "{")) - (sign in ("]", "}"))
            s[0] = sign == '"'
    if now is not None:
        yield row(now, state)


_EFFECTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("out_in", pa.bool_()), ("out_depth", pa.int64()),
                      ("in_in", pa.bool_()), ("in_depth", pa.int64())])
_CUT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("text", pa.string())])


def block_starts(pieces: DataFrame) -> DataFrame:
    """``file, block, inside, depth``: what every block begins with."""
    effects = pieces.mapInArrow(_effects, "file string, block long, out_in boolean, out_depth long, in_in boolean, in_depth long")
    fold = """aggregate(array_sort(collect_list(struct(block, out_in, out_depth, in_in, in_depth))),
      named_struct('inside', false, 'depth', 0L, 'starts', cast(array() AS array<struct<block: bigint, inside: boolean, depth: bigint>>)),
      (a, e) -> named_struct('inside', IF(a.inside, e.in_in, e.out_in), 'depth', a.depth + IF(a.inside, e.in_depth, e.out_depth),
                             'starts', array_append(a.starts, named_struct('block', e.block, 'inside', a.inside, 'depth', a.depth))),
      a -> a.starts)"""
    return effects.groupBy("file").agg(F.expr(fold).alias("starts")).select("file", F.inline("starts"))


def _cutter(starts):
    """(file, block, kind, text): ``whole`` elements; of a block's ends the
    ``head`` that goes on with an element begun before, and the ``tail`` where
    one begins that isn't finished."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now, held, kind, inside, depth = [], None, [], "", False, 0

        def add(which):
            if which:
                rows.append({"file": now[0], "block": now[1], "kind": which, "text": "".join(held)})
            held.clear()

        for file, block, text in _blocks(batches):
            if (file, block) != now:
                add(kind)
                now = (file, block)
                inside, depth = starts.value[now]
                kind = "head" if depth > 0 else ""  # before and after the array there is nothing
            begin = 0
            for at, sign in structure(text, inside):
                if sign in ("[", "{"):
                    depth += 1
                    if depth == 1:
                        held.clear()
                        begin, kind = at + 1, "tail"
                elif sign in ("]", "}"):
                    depth -= 1
                if (sign == "," and depth == 1) or (sign == "]" and depth == 0):
                    held.append(text[begin:at])
                    add("whole" if kind == "tail" else kind)
                    begin, kind = at + 1, "tail" if depth else ""
            inside = sign == '"'
            held.append(text[begin:])
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, _CUT)
                rows.clear()
        add(kind)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _CUT)
    return run


def read_json_array(spark: SparkSession, path: str, out: str = "metadata") -> DataFrame:
    """One row per element of the JSON array in each file of ``path``.

    The same rows as parsing each file whole (``explode_json_array``). What each
    block begins with, one small row a block, goes through the driver; reading
    must find the same blocks again, so the split size may not be changed between
    this call and the use of its result. An empty array has no rows; text before
    and after the array is ignored.
    """
    pieces = _pieces(spark, path)
    starts = {(r["file"], r["block"]): (r["inside"], r["depth"]) for r in block_starts(pieces).collect()}
    found = pieces.mapInArrow(_cutter(spark.sparkContext.broadcast(starts)), "file string, block long, kind string, text string")
    whole = found.where("kind = 'whole'").select("text")
    # the end of a block is the beginning of an element that goes on in the next ones
    place = F.col("block") * 2 + (F.col("kind") == "tail").cast("int")
    ends = found.where("kind IN ('head', 'tail')").withColumn("place", place)
    so_far = Window.partitionBy("file").orderBy("place")
    owner = F.max(F.when(F.col("kind") == "tail", F.col("block"))).over(so_far)
    joined = (ends.withColumn("owner", owner).where("owner IS NOT NULL").groupBy("file", "owner")
              .agg(F.expr("array_join(transform(array_sort(collect_list(struct(place, text))), x -> x.text), '')").alias("text")))
    every = whole.unionByName(joined.select("text")).where(F.trim(F.translate("text", "\n\r\t", "   ")) != "")
    one = F.get(F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), "array<string>"), 0)
    return every.select(one.alias(out))


@contextmanager
def split_bytes(spark: SparkSession, size: int):
    """Read files in splits of at most ``size`` bytes inside the block."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)
