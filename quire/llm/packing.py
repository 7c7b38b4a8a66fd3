"""Packing: optimal length buckets and token-budget batches.

Texts are cut into segments of at most ``max_len`` tokens. One aggregation
gives the histogram of segment lengths (at most ``max_len + 1`` rows, whatever
the input); dynamic programming over it chooses the bucket bounds with the
least padding. Inside a bucket every batch takes ``budget // bound`` rows.

Batches are dealt without gathering a bucket: rows are spread over slices,
numbered inside their (bucket, slice), and a running sum of the slice counts
turns that into the number inside the bucket, so only a bucket's last batch
can be short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import WORD, fresh, table, written

MAX_LEN = 2048
BUDGET = 16_384
BUCKETS = 8
#: A word with the separators behind it, the first also with those before it.
PIECE = rf"(?:^[\x20\x09-\x0D]+)?{WORD}[\x20\x09-\x0D]*"
NEW = ["segment", "start", "n_tokens", "bucket", "bucket_len", "batch", "position", "padding"]


def bucket_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The at most ``buckets`` upper bounds (ascending) that minimise
    ``sum(count * (bound - length))``; of equal sums the one found first with
    the shortest lower buckets."""
    order = np.argsort(lengths)
    size = np.asarray(lengths, np.int64)[order]
    n = len(size)
    if not n:
        return []
    count = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64)[order])])
    total = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64)[order] * size)])
    best = size * count[1:] - total[1:]  # one bucket over the first j+1 lengths
    cuts = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        now, cut = best.copy(), np.zeros(n, np.int64)
        for j in range(1, n):
            cost = best[:j] + size[j] * (count[j + 1] - count[1: j + 1]) - (total[j + 1] - total[1: j + 1])
            i = int(cost.argmin())
            if cost[i] < now[j]:
                now[j], cut[j] = cost[i], i + 1
        best = now
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        bounds.append(int(size[j - 1]))
        j = int(cut[j - 1])
        if j == 0:
            break
    return bounds[::-1]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def pack(docs: DataFrame, text: str = "text", length: Column | None = None, max_len: int = MAX_LEN,
         budget: int = BUDGET, buckets: int = BUCKETS, slices: int | None = None, with_text: bool = False) -> DataFrame:
    """One row per segment: the columns of ``docs`` but its text, plus
    ``segment, start, n_tokens`` (token range in the document), ``bucket``
    (from 0), ``bucket_len``, ``batch`` (from 0 in its bucket), ``position``
    and ``padding`` (``bucket_len - n_tokens``). ``with_text`` adds the text of
    the segment last, its separators included: the segments of a document in
    order give its text again. It needs words as tokens.

    ``length`` is the token count of a row (its words by default). A null,
    empty or blank text is one segment of no tokens. A very long text becomes
    several segments, none is dropped or cut off. Rows that are equal in every
    column stay apart. Clashing columns of ``docs`` are replaced; an empty
    table gives an empty table.
    """
    if not 0 < max_len <= budget:
        raise ValueError("max_len must be positive and at most the budget")
    if with_text and length is not None:
        raise ValueError("only words can be cut out of the text")
    spark = docs.sparkSession
    docs = docs.drop(*NEW)
    carried = [c for c in docs.columns if c != text]
    tokens, slice_ = fresh(docs, "tokens", "slice")
    sized = docs.withColumn(tokens, length if length is not None else word_count(F.col(text)))
    last = F.greatest(F.ceil(F.col(tokens) / max_len) - 1, F.lit(0)).cast("int")
    numbers, cut = F.sequence(F.lit(0), last), []
    if with_text:
        def part(pieces: Column, i: Column) -> Column:
            body = F.array_join(F.slice(pieces, i * max_len + 1, F.lit(max_len)), "")
            return F.struct(i.alias("segment"), F.when(F.col(tokens) > 0, body).otherwise(F.col(text)).alias("body"))
        # the pieces as an argument of the outer function: found once a row
        pieces = F.array(F.coalesce(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)), F.array().cast("array<string>")))
        numbers = F.element_at(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), last), lambda i: part(p, i))), 1)
        cut = [text]
    (each,) = fresh(sized, "each")
    segments = sized.select(*carried, tokens, F.explode(numbers).alias(each))
    segments = (segments.select(*carried, tokens, F.col(each)["segment"].alias("segment"), F.col(each)["body"].alias(text))
                if with_text else segments.withColumnRenamed(each, "segment"))
    segments = (segments
                .withColumn("start", F.col("segment").cast("long") * max_len)
                .withColumn("n_tokens", F.least(F.lit(max_len), F.col(tokens) - F.col("start")).cast("int"))
                .drop(tokens))
    segments = written(segments, "segments")
    hist = segments.groupBy("n_tokens").count().collect()  # at most max_len + 1 rows
    bounds = bucket_bounds([r["n_tokens"] for r in hist], [r["count"] for r in hist], buckets)

    n = slices or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = [c for c, kind in docs.dtypes if c in carried and not kind.startswith(("map", "array", "struct", "variant"))]
    spread = F.xxhash64(*(F.col(c) for c in [*plain, "segment"]))
    bucket = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(i)).otherwise(bucket)
    bucket_len = F.element_at(F.array(*(F.lit(b) for b in bounds or [0])), F.col("bucket") + 1)
    placed = segments.withColumn("bucket", bucket).withColumn(slice_, F.pmod(spread, F.lit(n)).cast("int"))

    # at most slices x buckets rows
    counts = placed.groupBy("bucket", slice_).count().collect()
    offsets, run = [], 0
    for i, r in enumerate(sorted(counts)):
        run = 0 if i == 0 or r["bucket"] != offsets[-1][0] else run
        offsets.append((r["bucket"], r[slice_], run))
        run += r["count"]
    (first,) = fresh(placed, "first_row")
    before = spark.createDataFrame(offsets, f"bucket int, `{slice_}` int, `{first}` long")
    inside = Window.partitionBy("bucket", slice_).orderBy(spread, *plain, "segment")
    row = F.col(first) + F.row_number().over(inside) - 1
    (at,) = fresh(placed, "row_in_bucket")
    per = F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))
    return (placed.join(before, ["bucket", slice_])
            .withColumn(at, row).withColumn("bucket_len", bucket_len)
            .withColumn("batch", F.floor(F.col(at) / per)).withColumn("position", F.col(at) % per)
            .withColumn("padding", F.col("bucket_len") - F.col("n_tokens"))
            .select(*carried, *NEW, *cut))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
