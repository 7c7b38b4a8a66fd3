"""Quality classifier: importance resampling.

Two generative models of hashed n-grams (words and punctuation runs, and their
pairs), one of the target texts and one of all texts, give every document the
weight ``log p_target - log p_raw``, summed over its n-grams. Gumbel noise of a
seeded hash of the id is added, and the ``k`` largest keys are the sample: a
draw without replacement in proportion to the weights.

The raw model counts every document; the target model counts the accepted
labelled documents, a sample of at most ``max_target`` of them by hash. Both
models have ``buckets`` cells, whatever the input.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import fresh, table, written

BUCKETS = 1 << 16
MAX_TARGET = 20_000
SEED = 5
TOKEN = re.compile(r"\w+|[^\w\s]+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Tokens hashed at once, and the words remembered by a task.
BLOCK = 1 << 19
CACHE = 1 << 18


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _cells(texts: Iterator[str | None], cache: _Hashes, buckets: int) -> Iterator[tuple[np.ndarray, int]]:
    """(n-gram cells, document number) in blocks; a very long text gives several blocks."""
    mask = np.uint64(buckets - 1)
    for doc, text in enumerate(texts):
        if not text:
            continue
        words = TOKEN.findall(text.lower())
        for i in range(0, len(words), BLOCK):
            part = words[max(i - 1, 0): i + BLOCK]
            h = np.fromiter(map(cache.__getitem__, part), np.uint64, len(part))
            pair = (h[:-1] * _PAIR + h[1:]) * _PAIR >> np.uint64(40)
            own = h if i == 0 else h[1:]
            yield np.concatenate([own & mask, pair & mask]).astype(np.int64), doc


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        cache = _Hashes()
        for b in batches:
            wanted = b.column(1).to_pylist()
            for cells, doc in _cells((t.as_py() for t in b.column(0)), cache, buckets):
                n = np.bincount(cells, minlength=buckets) if len(cells) > 4096 else None
                for to in [raw, target] if wanted[doc] else [raw]:
                    if n is None:
                        np.add.at(to, cells, 1)
                    else:
                        to += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])],
                                         ["cell", "raw", "target"])
    return run


def log_ratios(docs: DataFrame, target_ids: DataFrame, text: str = "text", doc_id: str = "doc_id",
               buckets: int = BUCKETS, max_target: int = MAX_TARGET) -> np.ndarray:
    """``log p_target - log p_raw`` by cell; zeros without target texts."""
    ids = (target_ids.select(F.col(target_ids.columns[0]).alias("wanted_id")).distinct()
           .orderBy(F.xxhash64("wanted_id"), "wanted_id").limit(max_target))
    marked = (docs.select(F.col(text).alias("body"), F.col(doc_id).alias("id"))
              .join(F.broadcast(ids), F.col("id") == F.col("wanted_id"), "left")  # at most max_target ids
              .select("body", F.col("wanted_id").isNotNull().alias("wanted")))
    got = (marked.mapInArrow(_count(buckets), "cell long, raw long, target long")
           .groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
           .toArrow())  # at most one row a cell
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = got["cell"].to_numpy()
    raw[at], target[at] = got["raw"].to_numpy(), got["target"].to_numpy()
    if not target.sum():
        return np.zeros(buckets)
    p_raw = (raw + 1) / (raw.sum() + buckets)
    p_target = (target + buckets * p_raw) / (target.sum() + buckets)
    return np.log(p_target) - np.log(p_raw)


def weigh(docs: DataFrame, ratios: np.ndarray, text: str = "text", name: str = "log_weight") -> DataFrame:
    """``docs`` with its text column last and the weight of every text behind it."""
    rest = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ratio = _Hashes(), shared.value
        for b in batches:
            w = np.zeros(b.num_rows)
            for cells, doc in _cells((t.as_py() for t in b.column(len(rest))), cache, len(ratio)):
                w[doc] += ratio[cells].sum()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w)], names=[*b.schema.names, name])

    src = docs.select(*(docs[c] for c in rest), docs[text])
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(name, T.DoubleType())]))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends only on the id and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """Exact k-th largest value of the one double column, by histograms that
    narrow to the bin holding it; ``bins`` rows reach the driver a round."""
    (c,) = keys.columns
    lo, hi, n = keys.agg(F.min(c), F.max(c), F.count(c)).first()
    if not n or k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    while lo < hi:
        step = (hi - lo) / bins
        inside = keys.where(F.col(c).between(lo, hi))
        at = F.least(F.floor((F.col(c) - lo) / step), F.lit(bins - 1)) if step > 0 else F.lit(0)
        rows = inside.groupBy(at.alias("bin")).agg(F.count(c).alias("n"), F.min(c).alias("lo"),
                                                   F.max(c).alias("hi")).collect()
        above = sum(r["n"] for r in keys.where(F.col(c) > hi).agg(F.count(c).alias("n")).collect())
        for r in sorted(rows, key=lambda r: -r["lo"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo


#: The rule of the target, for the model and for the share of it.
TARGET = "quality = 1 and not coalesce(toxic, 0) = 1"


def accepted_share(labels: DataFrame, good: Column) -> float:
    """Upper 3-sigma bound of the accepted share of labelled rows (1 without labels)."""
    n, g = labels.agg(F.count(F.lit(1)), F.sum(F.coalesce(good, F.lit(False)).cast("int"))).first()
    if not n:
        return 1.0
    p = g / n
    return min(1.0, p + 3 * math.sqrt(p * (1 - p) / n))


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
             keep_share: float | None = None, seed: int = SEED, buckets: int = BUCKETS,
             max_target: int = MAX_TARGET) -> DataFrame:
    """``docs`` plus ``log_weight, sample_key, kept``.

    ``labels`` has doc_id, quality and toxic; rows of quality 1 that are not
    toxic are the target. ``k`` is ``keep_share`` of the rows, by default the
    share of target rows among all labels plus three standard errors of it
    (binomial, by the number of labels), so a clean document isn't lost to the
    error of that share; the margin goes to 0 as labels grow. What the ranking
    mixes up at the cut is lost or kept; README has the counts. Keys equal to
    the k-th stay too.
    A null or empty text has weight 0; a null doc_id has the noise of null;
    repeated rows get equal keys. Clashing columns are replaced, extra ones
    carried; without labels or rows everything stays.
    """
    new = ["log_weight", "sample_key", "kept"]
    docs = docs.drop(*new)
    target = labels.where(TARGET).select("doc_id")
    ratios = log_ratios(docs, target, text, doc_id, buckets, max_target)
    share = accepted_share(labels.where("quality is not null"), F.expr(TARGET)) \
        if keep_share is None else keep_share
    scored = weigh(docs, ratios, text).withColumn("sample_key", F.col("log_weight") + gumbel(F.col(doc_id), seed))
    scored = written(scored.select(*docs.columns, "log_weight", "sample_key"), "scored")
    k = math.ceil(share * scored.count())
    least = kth_largest(scored.select("sample_key"), k)
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(least))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels")).drop("text")
