"""Exact dedup: two-pass Bloom filtering.

Pass 1 hashes every text and fills a Bloom filter that knows slots hit once
and slots hit more than once. Each task sends its slots by filter segment; a
segment's bitmaps are merged by one reducer holding only those bitmaps.
Pass 2 tests every row: only rows whose slots were all hit more than once
(possibly repeated) shuffle, on the SHA-256 of their text; the rest pass
straight through as groups of one.

The broadcast filter is at most ``max_filter_bytes``, whatever the input. The
filter has ``bits_per_hash`` bits a row up to that bound; beyond it more rows
are possibly repeated and shuffle, the result stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fresh, table, written

SEGMENT_BITS = 1 << 17
#: Slots per hash, each in an own half of the filter.
HALVES = 2


def _slots(h: np.ndarray, half_bits: int) -> np.ndarray:
    """(rows, HALVES) slot numbers of 64-bit hashes."""
    h = h.view(np.uint64)
    m = np.uint64(half_bits - 1)
    low = h & m
    high = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) & m
    return np.stack([low, high + np.uint64(half_bits)], axis=1).astype(np.int64)


def _fill(half_bits: int, segment_bits: int, block: int = 1 << 20):
    """Map side: (segment, offsets); an offset hit more than once here is sent twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush():
            slot, times = np.unique(np.concatenate(held), return_counts=True)
            slot = np.repeat(slot, np.minimum(times, 2))
            seg = slot // segment_bits
            cut = np.flatnonzero(np.diff(seg, prepend=-1))
            parts = np.split((slot % segment_bits).astype("<u4"), cut[1:])
            return pa.RecordBatch.from_arrays(
                [pa.array(seg[cut], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["segment", "offsets"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(_slots(b.column(0).to_numpy(zero_copy_only=False), half_bits).ravel())
            n += b.num_rows
            if n >= block:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()
    return run


def _merge(segment_bits: int):
    """Reduce side: the slots of each segment hit more than once, as packed bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        more: dict[int, np.ndarray] = {}
        for b in batches:
            for seg, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                off = np.frombuffer(data, "<u4")
                if seg not in once:
                    once[seg] = np.zeros(segment_bits, bool)
                    more[seg] = np.zeros(segment_bits, bool)
                twice = off[1:][off[1:] == off[:-1]]  # sorted
                more[seg][off[once[seg][off]]] = True
                more[seg][twice] = True
                once[seg][off] = True
        segs = [s for s in more if more[s].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(segs, pa.int64()), pa.array([np.packbits(more[s]).tobytes() for s in segs], pa.binary())],
            ["segment", "bits"])
    return run


def repeat_filter(hashes: DataFrame, bits_per_hash: int = 16, max_filter_bytes: int = 64 << 20) -> Column:
    """Pass 1 over the one long column of ``hashes``; a test for a hash column.

    Returns a function Column -> Column (boolean): false only for hashes that
    occur once.
    """
    spark = hashes.sparkSession
    want = max(hashes.count() * bits_per_hash // HALVES, SEGMENT_BITS)
    most = max_filter_bytes * 8 // HALVES
    half_bits = min(1 << (want - 1).bit_length(), 1 << (most.bit_length() - 1))  # powers of two
    segment_bits = min(SEGMENT_BITS, half_bits)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = (hashes.mapInArrow(_fill(half_bits, segment_bits), "segment long, offsets binary")
              .repartition(parts, "segment")
              .mapInArrow(_merge(segment_bits), "segment long, bits binary"))
    bits = np.zeros(half_bits * HALVES // 8, np.uint8)
    for row in merged.toLocalIterator():  # at most max_filter_bytes in all
        at = row["segment"] * (segment_bits // 8)
        bits[at: at + segment_bits // 8] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe_repeated(h: pd.Series) -> pd.Series:
        slot = _slots(h.to_numpy(np.int64), half_bits)
        hit = (shared.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=1))

    return maybe_repeated


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                normalise=None, bits_per_hash: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` plus ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after ``normalise`` (a Column -> Column,
    none by default); a null text counts as empty, so null and empty texts are
    one group. Of equal texts the largest doc_id stays. A null doc_id is less
    than any other: it stays only where a group has no other, with null
    keep_id. Rows that repeat both doc_id and text get the same verdict.
    Columns of ``docs`` that clash with the four new ones are replaced; other
    extra columns are carried. An empty table gives an empty table.
    """
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*new)
    body = F.coalesce(F.col(text), F.lit(""))
    body = normalise(body) if normalise else body
    test = repeat_filter(docs.select(F.xxhash64(body).alias("h")), bits_per_hash, max_filter_bytes)
    (flag,) = fresh(docs, "possibly_repeated")
    tested = docs.withColumn(flag, test(F.xxhash64(body)))
    sha = F.sha2(body, 256)
    rest = (tested.where(~F.col(flag)).drop(flag)
            .withColumns({"keep_id": F.col(doc_id), "group_size": F.lit(1).cast("long"),
                          "kept": F.lit(True), "text_sha256": sha}))
    some = tested.where(F.col(flag)).drop(flag).withColumn("text_sha256", sha)
    groups = some.groupBy("text_sha256").agg(F.max(doc_id).alias("keep_id"),
                                             F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "groups")  # both join sides are then dealt anew and a hot text can be split
    joined = some.join(groups, "text_sha256").withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id")))
    cols = docs.columns + new
    return rest.select(cols).unionByName(joined.select(cols))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).drop("text")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
