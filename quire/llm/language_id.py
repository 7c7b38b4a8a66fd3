"""Language ID: a byte convolutional network.

Bytes are embedded, filters of several widths slide over a fixed-length window,
each filter keeps its greatest response, and a softmax names the language. The
network is trained in numpy on windows of a bounded sample of labelled texts.
A text is judged by all its windows: their log-probabilities, weighted by the
bytes they hold, are averaged.

At prediction a filter is a sum of table rows, one row per byte and offset, so
batches of windows from many texts are looked up and added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import fresh, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
PAD = 0
#: Bound of the training sample: texts, and windows drawn from each.
MAX_TEXTS = 6_000
DRAWN = 4
STEPS = 900
BATCH = 96
SEED = 7
_LETTER = re.compile(r"[^\W\d_]")


def windows(data: bytes) -> np.ndarray:
    """Byte classes (byte + 1, 0 is padding) of ``data`` in rows of ``WINDOW``."""
    rows = max(1, -(-len(data) // WINDOW))
    out = np.zeros(rows * WINDOW, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    out[: len(data)] += 1
    return out.reshape(rows, WINDOW)


class Network:
    """Embedding, filters by width, and the softmax layer."""

    def __init__(self, classes: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"embed": rng.normal(0, 0.5, (257, EMBED))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes)))
        self.p["bias"] = np.zeros(len(classes))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        emb = p["embed"][x]
        pooled, kept = [], {}
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).swapaxes(2, 3).reshape(n, -1, w * EMBED)
            conv = view @ p[f"w{w}"] + p[f"b{w}"]
            at = conv.argmax(axis=1)
            top = np.take_along_axis(conv, at[:, None], 1)[:, 0]
            kept[w] = (view[np.arange(n)[:, None], at], at, top > 0)
            pooled.append(np.maximum(top, 0))
        hidden = np.concatenate(pooled, axis=1)
        z = hidden @ p["out"] + p["bias"]
        prob = np.exp(z - z.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(n), y] -= 1
        dz = prob * weight[:, None] / n
        g = {"out": hidden.T @ dz, "bias": dz.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        back = dz @ p["out"].T
        for i, w in enumerate(WIDTHS):
            patch, at, on = kept[w]
            d = back[:, i * FILTERS: (i + 1) * FILTERS] * on
            g[f"w{w}"] = np.einsum("bf,bfk->kf", d, patch)
            g[f"b{w}"] = d.sum(axis=0)
            parts = (d[:, :, None] * p[f"w{w}"].T).reshape(n, FILTERS, w, EMBED)
            where = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(g["embed"], where.ravel(), parts.reshape(-1, EMBED))
        g["embed"][PAD] = 0
        return g

    def tables(self) -> tuple[list[list[np.ndarray]], np.ndarray, np.ndarray]:
        """Per width and offset, the filters' response to each byte; softmax layer."""
        emb = self.p["embed"].copy()
        emb[PAD] = 0
        parts = []
        for w in WIDTHS:
            t = [emb @ self.p[f"w{w}"][o * EMBED: (o + 1) * EMBED] for o in range(w)]
            t[0] = t[0] + self.p[f"b{w}"]
            parts.append([a.astype(np.float32) for a in t])
        return parts, self.p["out"], self.p["bias"]


def train(texts: list[bytes], langs: list[str], seed: int = SEED) -> Network | None:
    """Adam on windows cut to random lengths, so that short texts are learned
    too; classes weigh the same. None without texts."""
    classes = sorted(set(langs))
    if not classes:
        return None
    net, rng = Network(classes, seed), np.random.default_rng(seed)
    net.p["embed"][PAD] = 0
    y = np.array([classes.index(v) for v in langs])
    share = len(y) / (len(classes) * np.bincount(y))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(texts), BATCH)
        size = np.where(rng.random(BATCH) < 0.5, rng.integers(4, 48, BATCH), WINDOW)
        x = np.zeros((BATCH, WINDOW), np.int64)
        for row, (i, s) in enumerate(zip(pick, size)):
            start = int(rng.integers(0, max(1, len(texts[i]) - s + 1)))
            part = np.frombuffer(texts[i][start: start + s], np.uint8)
            x[row, : len(part)] = part.astype(np.int64) + 1
        rate = 0.01 * (1 - step / (STEPS + 1))
        for k, g in net.gradients(x, y[pick], share[y[pick]]).items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.p[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    net.p["embed"][PAD] = 0
    return net


def log_probs(tables, x: np.ndarray, block: int = 64) -> np.ndarray:
    """Log-probabilities of each window (row of byte classes)."""
    parts, out, bias = tables
    hidden = np.empty((len(x), FILTERS * len(parts)), np.float32)
    for lo in range(0, len(x), block):
        ids = x[lo: lo + block]
        for i, offsets in enumerate(parts):
            n = WINDOW - len(offsets) + 1
            conv = offsets[0].take(ids[:, :n], axis=0)
            for o in range(1, len(offsets)):
                conv += offsets[o].take(ids[:, o: o + n], axis=0)
            hidden[lo: lo + block, i * FILTERS: (i + 1) * FILTERS] = conv.max(axis=1)
    z = np.maximum(hidden, 0) @ out + bias
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit(docs: DataFrame, wanted: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        max_texts: int = MAX_TEXTS) -> Network | None:
    """Train on at most ``max_texts`` labelled rows for which ``wanted`` holds,
    the first by hash, ``DRAWN`` windows from anywhere in each text.

    Rows of null label, or of null text or one without a letter, take no part;
    repeated rows count again, ties of the hash go by label and windows; an
    empty table, or one language alone, gives what ``train`` makes of it.
    """
    size = F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1
    drawn = [F.substring(F.col(text), F.pmod(F.xxhash64(doc_id, F.lit(i)), size).cast("int") + 1, F.lit(WINDOW))
             for i in range(DRAWN)]
    labelled = wanted & F.col(lang).isNotNull()
    picked = (docs.where(labelled & F.col(text).rlike(r"\p{L}"))
              .select(F.col(lang).alias("lang"), F.array(*drawn).alias("parts"),
                      F.xxhash64(doc_id, F.lit(SEED)).alias("h")))
    # a bound on the hash that lets a little more than the sample through, so no
    # task sends a sample of its own; raised if rows without letters left it short
    share = 1.25 * max_texts / max(docs.where(labelled).count(), 1)
    while True:
        near = picked if share >= 1 else picked.where(F.col("h") < int(share * 2 ** 64) - 2 ** 63)
        rows = near.orderBy("h", "lang", "parts").limit(max_texts).collect()
        if share >= 1 or len(rows) >= max_texts:
            break
        share *= 4
    texts = [(p.encode(), r["lang"]) for r in rows for p in dict.fromkeys(r["parts"]) if p]
    return train([t for t, _ in texts], [v for _, v in texts])


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``lang_pred`` and ``score``.

    A null text, or one without a letter, is ``und`` with score 0, and so is
    every text without a trained network. Whole texts count, however long.
    Extra columns are carried, clashing ones replaced; an empty table gives an
    empty table.
    """
    new = ["lang_pred", "score"]
    rest = [c for c in docs.columns if c != text and c not in new]
    shared = docs.sparkSession.sparkContext.broadcast((net.tables(), net.classes) if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            lang, score = ["und"] * b.num_rows, [0.0] * b.num_rows
            for rows, owner in _grouped(b.column(len(rest))) if model else ():
                total = np.zeros((b.num_rows, len(model[1])))
                weight = (rows != PAD).sum(axis=1)
                np.add.at(total, owner, log_probs(model[0], rows) * weight[:, None])
                size = np.bincount(owner, weight, b.num_rows)
                for i in np.unique(owner):
                    mean = total[i] / size[i]
                    prob = np.exp(mean - mean.max())
                    lang[i], score[i] = model[1][int(prob.argmax())], float(prob.max() / prob.sum())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*rest, *new])

    src = docs.select(*(docs[c] for c in rest), docs[text])
    return src.mapInArrow(run, T.StructType([*(docs.schema[c] for c in rest),
                                             T.StructField("lang_pred", T.StringType()),
                                             T.StructField("score", T.DoubleType())]))


def _grouped(texts: pa.Array, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of whole texts with letters, about ``most`` together, and their rows."""
    held, owner, n = [], [], 0
    for i, t in enumerate(texts):
        text = t.as_py()
        if text is None or not _LETTER.search(text):
            continue
        x = windows(text.encode())
        held.append(x)
        owner.append(np.full(len(x), i))
        n += len(x)
        if n >= most:
            yield np.concatenate(held), np.concatenate(owner)
            held, owner, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owner)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    (fold,) = fresh(docs, "fold")
    fold_of = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    net = fit(docs.withColumn(fold, fold_of), F.col(fold) != 2)
    held = F.coalesce(fold_of == 2, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), net)
