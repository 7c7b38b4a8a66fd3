"""Substring dedup: seed and extend.

Seeds: of every ``min_words`` consecutive words, the 5-word gram with the least
hash is a winnowed anchor, so two documents that share such a window share its
anchor. Anchors that occur in one document only drop out. Extend: around each
repeated anchor the windows that hold it are grown to both sides, one word at a
time, as hashes of their word sequence; a window met in a document with a
smaller doc_id is a match. Matched windows that overlap or touch add up to the
maximal repeats, whose words are removed.

Documents meet by anchor and by window, never as pairs: each task first
combines what it has, so a passage in any number of documents reaches a key's
reducer once a block of ``BLOCK`` words. What a task has settled rides along
under keys of its own. A window is compared by 63 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.common import fresh, table, words

MIN_WORDS = 13
GRAM = 5
#: Words hashed together, and words remembered by a task.
BLOCK = 1 << 20
CACHE = 1 << 19
_M = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (positions near the end: of fewer)."""
    g = h.copy()
    for j in range(1, k):
        g *= _M
        g[:-j] += h[j:]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def _spread(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each position and the ``width - 1`` after it."""
    out, span = x.copy(), 1
    while span < width:
        step = min(span, width - span)
        out[:-step] = pick(out[:-step], out[step:])
        span += step
    return out


class _Block:
    """Words of several documents in a row: hashes, and where each document lies."""

    def __init__(self, hashes: list[np.ndarray]):
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.left = np.repeat(self.end, self.size) - np.arange(len(self.h))  # words to the end

    def anchors(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors and the hashes at all positions."""
        width = min_words - GRAM + 1
        x = _grams(self.h, GRAM) | np.uint64(1)
        x[self.left < GRAM] = _TOP
        least = _spread(x, width, np.minimum)
        least[self.left < min_words] = 0  # no window starts here
        most = _spread(least[::-1], width, np.maximum)[::-1]
        return np.flatnonzero((most == x) & (x != _TOP)), x

    def windows(self, min_words: int) -> np.ndarray:
        return _grams(self.h, min_words)


def _alike(at: np.ndarray, marks: np.ndarray, value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions among ``at`` that have the value of a mark in the same document."""
    own = value + doc.astype(np.uint64) * _M  # within a document two values differ as before
    return at[np.isin(own[at], np.unique(own[marks]))]


def _combine(key: np.ndarray, doc: np.ndarray, at: np.ndarray, row: np.ndarray, any_other: bool) -> pa.RecordBatch:
    """(key, doc_id, at, settled): each row's first occurrence of a key.

    Under an even key the smallest document of the block; under odd keys of
    their own the others, for which a smaller document is known (settled).
    With ``any_other`` the smallest is settled too where it has others. Comes
    and goes in document order, in which shuffled rows compress well.
    """
    key = key & ~np.uint64(1)
    order = np.argsort(key, kind="stable")
    sorted_key, sorted_doc, sorted_row = key[order], doc[order], row[order]
    new_key = np.r_[True, sorted_key[1:] != sorted_key[:-1]][: len(key)]
    first = new_key.copy()
    first[1:] |= sorted_row[1:] != sorted_row[:-1]
    begin = np.flatnonzero(new_key)
    group = np.cumsum(new_key) - 1
    settled = sorted_doc > np.minimum.reduceat(sorted_doc, begin)[group] if len(key) else first
    known = settled | (np.bincount(group[settled], minlength=len(begin))[group] > 0) if any_other else settled
    back = np.argsort(order[first])
    at_, doc_ = at[order[first]][back], doc[order[first]][back]
    key_, settled, known = sorted_key[first][back], settled[first][back], known[first][back]
    own = ((at_.astype(np.uint64) ^ (doc_.astype(np.uint64) * _M) ^ (key_ >> np.uint64(7))) * _M) | np.uint64(1)
    key_ = np.where(settled, own, key_)
    return pa.RecordBatch.from_arrays([pa.array(key_.view(np.int64)), pa.array(doc_), pa.array(at_), pa.array(known)],
                                      ["key", "doc_id", "at", "settled"])


def _values(column: pa.Array) -> list:
    """Values of a column; lists as numpy arrays (views of the column's own)."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    cuts, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[x:y] if ok else None for x, y, ok in zip(cuts[:-1], cuts[1:], column.is_valid().to_pylist())]


def _doc_blocks(batches: Iterator[pa.RecordBatch], cache: _Hashes) -> Iterator[tuple[list, _Block]]:
    """Rows (all columns but the text) and their words' hashes, about ``BLOCK``
    words at a time. Rows with a null among their columns take no part."""
    rows, hashes, n = [], [], 0
    for b in batches:
        cols = [_values(b.column(i)) for i in range(1, b.num_columns)]
        for i, text in enumerate(b.column(0)):
            row = [c[i] for c in cols]
            if any(v is None for v in row):
                continue
            w = words(text.as_py() or b"")
            rows.append(row)
            hashes.append(np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)))
            n += len(w)
            if n >= BLOCK:
                yield rows, _Block(hashes)
                rows, hashes, n = [], [], 0
    if rows:
        yield rows, _Block(hashes)


def _keys(rows: list, block: _Block, at: np.ndarray, key: np.ndarray, any_other: bool) -> pa.RecordBatch:
    doc = np.repeat(np.arange(len(rows)), block.size)[at]
    ids = np.array([r[0] for r in rows], np.int64)[doc]
    tag = np.array([r[1] for r in rows], np.int64)[doc]
    return _combine(key[at], ids, (tag << 32) | (at - block.begin[doc]), doc, any_other)


def _seed(min_words: int):
    """(text, doc_id, tag) -> anchors."""
    def run(batches):
        cache = _Hashes()
        for rows, block in _doc_blocks(batches, cache):
            at, x = block.anchors(min_words)
            yield _keys(rows, block, at, x, True)
    return run


def _marked(rows: list, block: _Block, column: int) -> np.ndarray:
    """Block positions of the positions listed in a column of the rows."""
    parts = [r[column].astype(np.int64) + b for r, b in zip(rows, block.begin) if len(r[column])]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _extend(min_words: int):
    """(text, doc_id, tag, repeated anchor positions) -> windows that hold one."""
    def run(batches):
        cache = _Hashes()
        for rows, block in _doc_blocks(batches, cache):
            doc = np.repeat(np.arange(len(rows)), block.size)
            at, x = block.anchors(min_words)
            near = np.zeros(len(block.h) + 1, np.int64)
            hit = _alike(at, _marked(rows, block, 2), x, doc)
            np.add.at(near, np.maximum(hit - (min_words - GRAM), block.begin[doc[hit]]), 1)
            np.add.at(near, hit + 1, -1)
            start = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (block.left >= min_words))
            yield _keys(rows, block, start, block.windows(min_words), False)
    return run


def _kept(texts: list[list[bytes]], starts: list[np.ndarray], min_words: int, cache: _Hashes) -> list[np.ndarray]:
    """For the words of several documents, which are kept: those outside the
    windows whose sequences, wherever they start in a document, stand at its
    ``starts``."""
    block = _Block([np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)) for w in texts])
    doc = np.repeat(np.arange(len(texts)), block.size)
    marks = np.concatenate([s.astype(np.int64) + b for s, b in zip(starts, block.begin)])
    start = _alike(np.flatnonzero(block.left >= min_words), marks, block.windows(min_words), doc)
    cover = np.zeros(len(block.h) + 1, np.int64)
    cover[start] += 1
    cover[start + min_words] -= 1
    keep = np.cumsum(cover)[:-1] == 0
    return [keep[x:y] for x, y in zip(block.begin, block.end)]


def kept_rows(texts: list[bytes], starts: list, min_words: int, cache: _Hashes) -> Iterator[tuple[int, int, bytes]]:
    """Word count, words removed and what is left of every text, in order; the
    texts with starts are looked at about ``BLOCK`` words together."""
    held, n = [], 0  # words of the rows whose turn is not yet, with their starts

    def flush():
        some = [(w, s) for w, s in held if s is not None and len(s)]
        masks = iter(_kept([w for w, _ in some], [s for _, s in some], min_words, cache) if some else ())
        for w, s in held:
            keep = next(masks) if s is not None and len(s) else None
            gone = 0 if keep is None else int(len(w) - keep.sum())
            yield len(w), gone, b" ".join(compress(w, keep.tolist()) if gone else w)
        held.clear()

    for text, s in zip(texts, starts):
        w = words(text or b"")
        held.append((w, s))
        n += len(w)
        if n >= BLOCK:
            yield from flush()
            n = 0
    yield from flush()


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its text replaced by ``n_words, n_removed, kept_text``.

    Words ``[^\\x20\\x09-\\x0D]+`` covered by a window of ``min_words`` words that
    also starts in a document with a smaller doc_id are removed; the others
    are joined by one space. Windows are judged on the input. A null, empty or
    blank text has no words; a null doc_id is neither smaller nor larger than
    any, so nothing is removed there or on its account. Rows with one doc_id
    don't remove from each other. Extra columns are carried, clashing ones
    replaced; an empty table gives an empty table.
    """
    if min_words < GRAM:
        raise ValueError(f"windows of at least {GRAM} words")
    new = ["n_words", "n_removed", "kept_text"]
    docs = docs.drop(*new)
    rest = [c for c in docs.columns if c != text]
    body, tag, marks = fresh(docs, "body", "tag", "marks")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(text).cast("binary").alias(body), *rest,
                      F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 31)).alias(tag))
    # one deal of the texts serves all three passes (left joins leave it unfiltered, so it is reused)
    dealt = src.repartition(n, doc_id, tag)
    schema = "key long, doc_id long, at long, settled boolean"
    own = [F.col(body), F.col(doc_id).cast("long").alias("doc_id"), F.col(tag).alias("tag")]

    def listed(found: DataFrame) -> DataFrame:
        """Positions by document, named as in ``docs``."""
        return (found.groupBy(F.col("doc_id").alias(doc_id), F.shiftright("at", 32).alias(tag))
                .agg(F.collect_list(F.expr("int(at & 4294967295L)")).alias(marks)))

    key = Window.partitionBy("key")
    seeds = dealt.select(*own).mapInArrow(_seed(min_words), schema)
    again = F.col("settled") | (F.min("doc_id").over(key) < F.max("doc_id").over(key))
    repeated = seeds.withColumn("again", again).where("again")
    with_seeds = dealt.join(listed(repeated), [doc_id, tag], "left").select(*own, marks)
    grown = with_seeds.mapInArrow(_extend(min_words), schema)
    smaller = F.col("settled") | (F.min("doc_id").over(key) < F.col("doc_id"))
    covered = grown.withColumn("smaller", smaller).where("smaller")
    joined = dealt.join(listed(covered), [doc_id, tag], "left").select(*rest, body, marks)
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for b in batches:
            got = kept_rows(b.column(at).to_pylist(), _values(b.column(at + 1)), min_words, cache)
            total, gone, kept = zip(*got) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:at], pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=[*rest, *new])

    out = T.StructType([*(docs.schema[c] for c in rest), T.StructField("n_words", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(run, out)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed",
                                        F.sha2("kept_text", 256).alias("kept_sha256"))
