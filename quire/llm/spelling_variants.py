"""Spelling variant grouping: reduced-alphabet generation.

Words and their counts come from one pass over the texts (counted in the task,
then by word). Every letter is hashed to one of a few symbols; a word's reduced
form is the sequence of its letters' symbols. One edit of a word is at most one
edit of its reduced form, so near words have reduced forms that are equal or in
each other's one-edit neighbourhood. The whole neighbourhood is generated, each
pair of reduced forms from one side: from the longer one by deleting a symbol,
of two equally long ones by replacing a symbol by a higher one, and the form
itself for letters that share a symbol.

A reduced form can stand for very many words. An edit leaves one half of the
word as it is, so the join key is the reduced form, the half, and a hash of the
original letters of that half: every generated form knows its edit's place and
has one key, every word has two, and words that share a form but neither half
never meet. What meets is verified on the original strings.

Reduced forms are numbers (a polynomial of the symbols modulo 2^64), computed
for all edits of a word at once; only keys and word numbers are shuffled, and a
word of any length takes a few numbers per letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table, written

#: A run of letters; its deletion is drawn one time in ``DRAW``.
RUN = r"[A-Za-zÀ-ÿ]+"
DRAW = 97
MIN_LENGTH = 5
MIN_COUNT = 3
#: A form is at least so many times as frequent as its variant.
RATIO = 2
#: Symbols of the reduced alphabet; letters in a block of words; words counted by a task.
SYMBOLS = 4
BLOCK = 1 << 18
HELD = 1 << 19

_RUN = re.compile("[a-zÀ-ÿ]+")
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def runs(text: str) -> list[str]:
    """The runs of a text, A-Z lower-cased (``bytes.lower`` changes nothing else)."""
    return _RUN.findall(text.encode("utf-8", "replace").lower().decode())


def drawn(doc_id, counts: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Words and counts of one document's runs: a run whose CRC-32 of
    ``<doc_id>:<run>`` is divisible by ``DRAW`` loses one code point. Without a
    doc_id there is no number, and nothing is lost."""
    start = None if doc_id is None else zlib.crc32(b"%s:" % str(doc_id).encode())
    for run, n in counts.items():
        if start is not None:
            h = zlib.crc32(run.encode(), start)
            if h % DRAW == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
        yield run, n


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n``: every word of at least ``MIN_LENGTH`` code points and its occurrences."""
    src = docs.select(F.col(doc_id), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, body in zip(b.column(0), b.column(1)):
                for word, n in drawn(i.as_py(), Counter(runs(body.as_py() or ""))):
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    counted = src.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Reduced:
    """A block of words laid end to end, with prefix sums of two polynomials:
    of the symbols (reduced forms) and of the code points (halves)."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.at = np.arange(len(points)) - self.begin[self.word]
        most = int(self.size.max(initial=0)) + 2
        self.power = np.concatenate([[np.uint64(1)], np.full(most, _B)]).cumprod(dtype=np.uint64)
        self.symbol = (_mix(points * _B) >> np.uint64(13)) % np.uint64(SYMBOLS) + np.uint64(1)
        self.form = self._sums(self.symbol)
        self.text = self._sums(_mix(points + np.uint64(1)))
        self.code = self.form[self.begin + self.size] - self.form[self.begin]

    def _sums(self, value: np.ndarray) -> np.ndarray:
        return np.concatenate([[np.uint64(0)], (value * self.power[self.at]).cumsum(dtype=np.uint64)])

    def half(self, word: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Hash of the code points ``start`` to ``end`` of words, the first one
        counted as place ``base``: the same for the same letters."""
        b = self.begin[word]
        span = self.text[b + end] - self.text[b + start]
        back = np.concatenate([[np.uint64(1)], np.full(len(self.power), _B_INVERSE)]).cumprod(dtype=np.uint64)
        moved = np.where(start >= base, span * back[np.maximum(start - base, 0)], span * self.power[np.maximum(base - start, 0)])
        return moved + (end - start).astype(np.uint64) * _MIX


def _key(code: np.ndarray, size: np.ndarray, second: np.ndarray, half: np.ndarray) -> np.ndarray:
    return _mix(_mix(code + size.astype(np.uint64) * _MIX) ^ (half * _B) ^ second.astype(np.uint64)).view(np.int64)


def own_keys(r: Reduced) -> tuple[np.ndarray, np.ndarray]:
    """(word, key): each word's form with its first and with its second half."""
    w, zero = np.arange(len(r.size)), np.zeros(len(r.size), np.int64)
    cut = r.size // 2
    first = _key(r.code, r.size, zero, r.half(w, zero, cut, zero))
    second = _key(r.code, r.size, zero + 1, r.half(w, cut, r.size, cut))
    return np.concatenate([w, w]), np.concatenate([first, second])


def _edit_keys(r: Reduced, code: np.ndarray, shorter: int) -> np.ndarray:
    """Key of an edit at every place: the new form and the half it leaves alone.

    The halves are those of the new form, ``shorter`` symbols shorter than the
    word: an edit in its second half leaves the first as it is.
    """
    w, size = r.word, r.size[r.word] - shorter
    cut = size // 2
    second = r.at < cut  # the edit is in the first half, the second stays
    start = np.where(second, cut + shorter, 0)
    end = np.where(second, size + shorter, cut)
    return _key(code, size, second, r.half(w, start, end, np.where(second, cut, 0)))


def neighbour_keys(r: Reduced) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) of the one-edit neighbourhood: replaced by a higher or the
    same symbol, and deleted. An insertion is the longer word's deletion."""
    place, code = r.power[r.at], r.code[r.word]
    out = []
    for higher in range(SYMBOLS):  # 0: another letter of the same symbol
        ok = r.symbol + np.uint64(higher) <= np.uint64(SYMBOLS)
        out.append((r.word[ok], _edit_keys(r, code + np.uint64(higher) * place, 0)[ok]))
    at = r.begin[r.word] + r.at
    before = r.form[at] - r.form[r.begin[r.word]]
    after = r.form[r.begin[r.word] + r.size[r.word]] - r.form[at + 1]
    out.append((r.word, _edit_keys(r, before + after * _B_INVERSE, 1)))
    return np.concatenate([w for w, _ in out]), np.concatenate([k for _, k in out])


def _keyed(vocabulary: DataFrame, keys) -> DataFrame:
    """``key, id`` of every word, a block of words at a time, each pair once a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids, words):
            word, key = keys(Reduced(words))
            order = np.lexsort((key, word))
            word, key = word[order], key[order]
            new = np.r_[True, (word[1:] != word[:-1]) | (key[1:] != key[:-1])][: len(word)]
            return pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(np.array(ids, np.int64)[word[new]])], names=["key", "id"])

        ids, words, n = [], [], 0
        for b in batches:
            for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                words.append(w)
                n += len(w)
                if n >= BLOCK:
                    yield block(ids, words)
                    ids, words, n = [], [], 0
        if words:
            yield block(ids, words)

    return vocabulary.select("id", "word").mapInArrow(run, "key long, id long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: both directions of every two words one edit
    apart, of a written vocabulary ``id`` (a number of its own), ``word``, ``n``."""
    a = _keyed(vocabulary, neighbour_keys)
    b = _keyed(vocabulary, own_keys).withColumnRenamed("id", "other_id")
    met = a.join(b, "key").where("id <> other_id").select("id", "other_id").distinct()
    left = vocabulary.select("id", "word", "n")
    right = vocabulary.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = (met.join(left, "id").join(right, "other_id").where(F.levenshtein("word", "other", 1) == 1)
            .select("word", "n", "other", "other_n"))
    return near.union(near.select("other", "other_n", "word", "n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every ``word, form``: pointers are doubled until none
    moves. A form is at least twice as frequent as its variant, so chains are no
    longer than the binary logarithm of the largest count."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                     F.col("next").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts.

    Words, near words, forms and roots as in the module; a word without near
    words has no form and is its own root. A null, empty or letterless text has
    no words; a null doc_id keeps its runs whole. Repeated rows count again.
    Runs of any length are read whole. Ties for the form go to the word that is
    smallest in code-point order. Other columns take no part; an empty table
    gives no rows.
    """
    words = written(word_counts(docs, text, doc_id).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    near = near_pairs(words)
    best = F.min(F.struct((-F.col("other_n")).alias("least"), F.col("other")))
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.select("word", "n").join(found, "word", "left")
    has = -F.col("best.least") >= RATIO * F.col("n")
    out = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.least")).alias("form_n")), "forms")
    end = roots(out.where("form IS NOT NULL"))
    return (out.join(end, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
