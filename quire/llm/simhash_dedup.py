"""SimHash near-dedup: multi-index hashing.

A document's fingerprint takes one pass over its words. Equal fingerprints
become one class. The 64 bits are cut into two segments of 32; two
fingerprints within 3 bits have a segment within 1 bit, so a table of exact
segment values is probed with the Hamming ball of radius 1 around every
segment. Each ball is enumerated from above only: of two values one bit apart,
one has that bit set, and clearing its set bits reaches the other. Matches are
verified on all 64 bits.

The segments and their balls are some 2 and 32 times as many rows as the
fingerprints, which Spark's size of an ``explode`` doesn't tell, so their joins
are asked to be sort merge joins: no table of them is gathered and broadcast.

Copies never meet as pairs (they are one class). The probe joins carry the
distance test, so only verified links leave them; a hot segment value is split
over tasks by the adaptive skew join. Links are reduced to spanning forests
before components are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import components, fresh, table, words, written

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Words hashed at once; bounds the memory of a very long text.
BLOCK = 1 << 16


def _hashes(w: list[bytes], shingle: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle))))
    return np.array([h(g, SEED) for g in grams], "<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of A-Z lower-cased UTF-8 text; 0 for a text without words."""
    w = words(text.lower())
    if not w:
        return 0
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    ones = np.zeros(64, np.int64)
    n = len(w) - shingle + 1
    for i in range(0, n, BLOCK):
        h = _hashes(w[i: i + BLOCK + shingle - 1], shingle)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # uint8 sums stay exact
            ones += bits[j: j + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE,
                 name: str = "fp") -> DataFrame:
    """``docs`` with its text column replaced by the fingerprint as a long."""
    rest = [c for c in docs.columns if c != text]
    src = docs.select(*(docs[c] for c in rest), docs[text].cast("binary").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(v.as_py() or b"", shingle) for v in b.column(len(rest))], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))],
                                             names=[*rest, name])

    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(name, T.LongType())])
    return src.mapInArrow(run, schema)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints (one long column ``fp``)
    at most ``max_bits`` (at most 3) bits apart; every such pair is joined by
    a path of edges, and every edge is such a pair."""
    if max_bits > 3:
        raise ValueError("two segments with balls of radius 1 reach 3 bits")
    segment = F.expr("explode(array(fp & 4294967295L, shiftrightunsigned(fp, 32) | 4294967296L))")
    exact = fps.select(segment.alias("seg"), F.col("fp").alias("u"))
    ball_seg = F.expr("seg ^ shiftleft(1L, bit)")
    probes = (exact.select("seg", F.col("u").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
              .where("seg & shiftleft(1L, bit) <> 0").select(ball_seg.alias("seg"), "v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    exact = exact.hint("merge")
    ball = exact.join(probes, "seg").where(near).select("u", "v")
    twin = exact.select("seg", F.col("u").alias("v"))
    same = exact.join(twin, "seg").where((F.col("u") < F.col("v")) & near).select("u", "v")
    return ball.union(same)


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  shingle: int = SHINGLE, max_bits: int = MAX_BITS, group: str | None = None) -> DataFrame:
    """``docs`` without its text, plus ``fingerprint`` (16 hex digits) and
    ``component_id`` (smallest doc_id reachable by links, itself included).

    A null, empty or blank text has fingerprint zero and links like any other.
    A null doc_id takes part in linking but names no component unless no
    member has an id (then null); ``group`` adds a column of that name that
    tells components apart in that case too. Repeated rows stay and share a component;
    extra columns are carried, clashing ones replaced; an empty table gives an
    empty table.
    """
    docs = docs.drop("fingerprint", "component_id")
    (fp,) = fresh(docs, "fp")
    marked = written(fingerprints(docs, text, shingle, fp), "fingerprints")
    classes = written(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("rep")), "classes")
    roots = components(links(classes.select("fp"), max_bits))
    linked = written(classes.join(roots.select(F.col("u").alias("fp"), "root"), "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "component_id", "root")
    final = written(classes.join(moved, "fp", "left")
                    .select(F.col("fp").alias(fp), F.coalesce("component_id", "rep").alias("component_id"),
                            *([F.coalesce("root", "fp").alias(group)] if group else [])),
                    "components")
    out = marked.join(final, fp)
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))).drop(fp)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_dedup(docs).select("doc_id", "fingerprint", "component_id")
