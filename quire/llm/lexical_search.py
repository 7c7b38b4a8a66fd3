"""Ranked lexical search: NRA over impact-sorted lists.

Two passes over the documents. The first reads every text once and writes, per
document, its length and the counts of the query terms in it; document counts
and lengths of the whole corpus follow from that table. In the second each task
takes blocks of documents, turns a block into one list per term, sorted by
impact (what the term adds to the document's score), and answers every query on
it; the best of all blocks are ranked by windows.

A query on a block reads its terms' lists from the top, sequentially and by
falling impact, and never looks a document up. A document's lower bound is what
has been read of it; its upper bound adds, for every list it hasn't been met in,
the next impact of that list. While what an unseen document could still reach
is not below the ``k``-th best lower bound, documents enter; from then on only
documents already met are followed, and one whose upper bound falls below the
``k``-th lower bound is dropped. Reading goes on until every document left has
a final score, so membership, ties and scores are exact.

A block holds a bounded number of counts and the broadcast a bounded number of
query terms: more queries are answered in blocks of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.window import Window

from quire.llm.common import table, written

#: Best documents of a query.
TOP = 50
#: (query, term) pairs answered together (broadcast), and counts in a block.
QUERY_TERMS = 1 << 18
BLOCK = 1 << 21
#: Each round reads what is above this share of the last round's impacts.
STEP = 0.5
#: Rows of a query ranked together before the last window.
SALT = 64

#: A term in UTF-8: the pattern's code points are ASCII letters and digits and
#: everything from U+0080 on, whose bytes are all 80 or more.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: bytes) -> list[bytes]:
    """Terms of UTF-8 text, with repeats; ``bytes.lower`` changes A-Z alone."""
    return _TERM.findall(text.lower())


def query_blocks(queries: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """Lists of ``(row of the query, item_id, its distinct terms)`` of about
    ``QUERY_TERMS`` terms; the queries are read by one iterator over their partitions."""
    block, n = [], 0
    rows = queries.select(F.col(item_id), F.col(text).cast("binary")).toLocalIterator()
    for at, (item, body) in enumerate(rows):
        found = sorted(set(terms(bytes(body)))) if body else []
        if not found:
            continue
        block.append((at, item, found))
        n += len(found)
        if n >= QUERY_TERMS:
            yield block
            block, n = [], 0
    if block:
        yield block


def _counted(docs: DataFrame, doc_id: str, text: str, names) -> DataFrame:
    """``doc_id, n, term, tf`` (arrays) of every document with a term."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = names.value
        for b in batches:
            keep, length, at, tf, cuts = [], [], [], [], [0]
            for i, v in enumerate(b.column(1)):
                body = v.as_py()
                found = terms(body) if body else ()
                if not found:
                    continue
                keep.append(i)
                length.append(len(found))
                counts = Counter(found)
                for t in counts.keys() & number.keys():
                    at.append(number[t])
                    tf.append(counts[t])
                cuts.append(len(at))
            offsets = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int32())), pa.array(length, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], names=["doc_id", "n", "term", "tf"])

    return src.mapInArrow(run, T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()),
        T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))]))


class Lists:
    """The impact-sorted lists of a block of documents."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int):
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.docs = doc[order], impact[order], docs
        self.term, self.begin = np.unique(term[order], return_index=True)
        self.end = np.append(self.begin[1:], len(term))

    def of(self, query: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(documents, impacts)`` of the query's terms, impacts falling."""
        at = np.flatnonzero(np.isin(self.term, query))
        return [(self.doc[self.begin[i]: self.end[i]], self.impact[self.begin[i]: self.end[i]]) for i in at]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents (numbers below ``docs``) and their scores above
    0, best first, equal scores by number."""
    lists = [(d, s) for d, s in lists if len(d) and s[0] > 0]
    at = [0] * len(lists)
    ahead = np.array([s[0] for _, s in lists], np.int64)  # the next impact of a list, 0 at its end
    met = [np.zeros(0, np.int64)] * len(lists)  # places of the documents met in a list
    live = np.arange(docs)  # documents followed; slot[d] is the place of document d, or -1
    slot, lower = live, np.zeros(docs, np.int64)
    level = float(ahead.max(initial=0))
    while ahead.any():
        level = min(level * STEP, float(ahead.max()) - 1)
        for i, (doc, impact) in enumerate(lists):
            if ahead[i] <= level:
                continue
            stop = len(impact) - int(np.searchsorted(impact[::-1], level, "right"))
            place = slot[doc[at[i]: stop]]
            new = place[place >= 0]
            lower[new] += impact[at[i]: stop][place >= 0]  # a document is once in a list
            met[i] = np.concatenate([met[i], new])
            at[i], ahead[i] = stop, impact[stop] if stop < len(impact) else 0
        if len(live) > k:
            upper = lower + ahead.sum()
            for places, value in zip(met, ahead):
                if value:
                    upper[places] -= value
            least = max(int(np.partition(lower, len(lower) - k)[len(lower) - k]), 1)
            stay = upper >= least
            if not stay.all():
                live, lower = live[stay], lower[stay]
                slot = np.full(docs, -1)
                slot[live] = np.arange(len(live))
                moved = np.cumsum(stay) - 1
                met = [moved[places[stay[places]]] for places in met]
    best = np.lexsort((live, -lower))[:k]
    best = best[lower[best] > 0]
    return live[best], lower[best]


def _searched(found: DataFrame, weights, n_docs: int, n_terms: int, top: int, item_type) -> DataFrame:
    """``query, item_id, doc_id, score``: the best of each block of documents."""
    id_type = found.schema["doc_id"].dataType

    def blocks(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b.column(2).values)
            if n >= BLOCK:
                yield held
                held, n = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, queries = weights.value
        for held in blocks(batches):
            t = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()  # nulls last; equal scores follow
            n = t.column("n").to_numpy()
            norm = 100 - 50 + (50 * n * n_docs) // n_terms
            lens = pc.list_value_length(t.column("term")).to_numpy()
            term = pc.list_flatten(t.column("term")).to_numpy()
            tf = pc.list_flatten(t.column("tf")).to_numpy()
            doc = np.repeat(np.arange(len(n)), lens)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc]))
            lists, out = Lists(term, doc, impact, len(n)), []
            for at, item, of in queries:
                docs, scores = nra(lists.of(of), len(n), top)
                if len(docs):
                    out.append((at, item, docs, scores))
            if out:
                size = [len(d) for _, _, d, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([q for q, _, _, _ in out], size), pa.int64()),
                     pa.array([i for (_, i, d, _) in out for _ in d], item_type),
                     t.column("doc_id").combine_chunks().take(pa.array(np.concatenate([d for _, _, d, _ in out]))),
                     pa.array(np.concatenate([s for _, _, _, s in out]), pa.int64())],
                    names=["query", "item_id", "doc_id", "score"])

    return found.mapInArrow(run, T.StructType([
        T.StructField("query", T.LongType()), T.StructField("item_id", from_arrow_type(item_type)),
        T.StructField("doc_id", id_type), T.StructField("score", T.LongType())]))


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, text: str = "text", doc_id: str = "doc_id",
           item_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each query with
    a score above 0, equal scores by ascending doc_id.

    A null or empty text, or one without a term, is no document and asks for
    nothing. Each row is a document and each row a query of its own: a repeated
    doc_id is ranked once a row, a repeated item_id answered once a row. A null
    doc_id comes after the others, a null item_id is answered like any. Texts of
    any length are read whole. Other columns of either table take no part; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    schema = T.StructType([T.StructField("item_id", queries.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
    item_type = to_arrow_type(schema["item_id"].dataType)
    out = spark.createDataFrame([], schema)
    for block in query_blocks(queries, item_id, query_text):
        number = {t: i for i, t in enumerate(sorted({t for _, _, ts in block for t in ts}))}
        found = written(_counted(docs, doc_id, text, sc.broadcast(number)), "counts")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = found.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        w = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1)))
        weight = np.zeros(len(number), np.int64)
        for t, value in df.select("term", w).collect():  # a row a query term
            weight[t] = value
        wanted = [(at, item, np.array([number[t] for t in ts], np.int32)) for at, item, ts in block]
        best = _searched(found.where(F.size("term") > 0), sc.broadcast((weight, wanted)), n_docs, n_terms, top, item_type)
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        part = Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).orderBy(*order)
        some = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
        ranked = (some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
                  .where(F.col("rank") <= top))
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out


#: DuckDB: every document scored for every item.
SQL = f"""WITH dt AS (
  SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
dl AS (SELECT r, doc_id, regexp_extract_all(s, '{TERM}') AS t FROM dt),
d AS (SELECT r, doc_id, t, len(t) AS n FROM dl WHERE len(t) > 0),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
s AS (SELECT q.item_id, p.r, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * d.n * c.nn) // c.ll)))) AS BIGINT) AS score
      FROM q JOIN p ON q.term = p.term JOIN w ON w.term = p.term JOIN d ON d.r = p.r, c GROUP BY q.item_id, p.r),
k AS (SELECT s.item_id, CAST(row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id) AS INTEGER) AS rank,
             d.doc_id, s.score FROM s JOIN d ON d.r = s.r WHERE s.score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
