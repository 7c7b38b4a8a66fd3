"""BPE encoding and decoding: a bounded-lookahead streaming transducer.

Encoding reads a text from left to right and emits tokens once no later byte
can change them. How far that is follows from the merge list alone. Apply the
merges rank by rank to two texts with the same first ``n`` bytes: their cuts
agree up to a frontier, at first ``n``. Merge ``(u, v)`` moves the frontier
only if ``u`` ends there, by ``len(u)`` to the left; whatever then starts at
the frontier has ``u`` on its left spine. So the frontier moves along a chain of
merges of rising rank in which each left part is on the left spine of the next
right part, and the longest chain's left parts add up to the sufficient
``lookahead``. A cut that far from the end of the buffer is final, and the text
behind a final cut is encoded on its own.

Every piece is read by the transducer, byte by byte: it knows the last token of
each prefix (``merges``), and the chain of these tokens back from a stable cut
is the encoding. Pieces met again come from a bounded table. Decoding turns ids into bytes and feeds them
to an incremental UTF-8 state machine that keeps at most an unfinished
character. State is constant in the length of the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quire.llm.common import over_text, table
from quire.llm.merges import Machine, Merges, Table, spare_collector

#: Characters of a text looked at together, and bytes of a piece read between
#: two emissions.
PART = 1 << 18
BLOCK = 1 << 12

_CUT = regex.compile(r"(?<=\S)(?=\s)")


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 up, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A byte-level BPE vocabulary with its merges, from a tokenizer's JSON text."""

    def __init__(self, source: str, pattern: str):
        spec = json.loads(source)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level BPE")
        to_byte = byte_alphabet()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if s not in special}
        self.bytes_of = raw | {i: s.encode() for s, i in special.items()}
        self.text_of = {i: b"%d" % i for i in self.bytes_of}
        self.single = {b[0]: i for i, b in raw.items() if len(b) == 1}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = special
        names = sorted(special, key=len, reverse=True)
        self.special_re = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pieces = regex.compile(pattern)
        self.lookahead = self._lookahead()
        self.machine = Machine(Merges(((u, v, m) for (u, v), (_, m) in self.ranks.items()), raw))
        self.cache = Table(self._piece)

    def _lookahead(self) -> int:
        left: dict[int, int] = {}  # a merged token's left part
        reach: dict[int, int] = {}  # by left part: the longest chain that ends with it
        most = 0
        for (u, v), (_, merged) in self.ranks.items():  # in rank order
            x, longest = v, 0
            while x is not None:
                longest = max(longest, reach.get(x, 0))
                x = left.get(x)
            own = longest + len(self.bytes_of[u])
            reach[u] = max(reach.get(u, 0), own)
            most = max(most, own)
            left.setdefault(merged, u)
        return most

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """The transducer: tokens of one piece given in chunks, as they become
        stable. It holds the tokens of the last ``lookahead`` bytes and a chunk."""
        state, said, size = 0, [], self.machine.merges.size
        for c in chunks:
            state = self.machine.read(state, c, said)
            cut = len(said)
            while cut > 0 and cut > len(said) - self.lookahead:
                cut -= size[said[cut - 1]]
            yield self.machine.chain(said, cut)
            del said[:cut]
        yield self.machine.chain(said, len(said))

    def _piece(self, piece: str) -> Iterable[int]:
        data = piece.encode("utf-8", "replace")
        return chain.from_iterable(self.stream(data[i: i + BLOCK] for i in range(0, len(data), BLOCK)))

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text`` in blocks, special tokens in the text included."""
        at = 0
        for m in self.special_re.finditer(text) if self.special_re else ():
            yield from self._plain(text, at, m.start())
            yield [self.special[m[0]]]
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        while at < end:
            # no piece holds a non-space followed by a space
            cut = _CUT.search(text, min(at + PART, end), end) if at + PART < end else None
            stop = cut.start() if cut else end
            yield list(chain.from_iterable(map(self.cache.__getitem__, self.pieces.findall(text[at:stop]))))
            at = stop

    def decoder(self):
        """A function from ids to the text that is finished; ``None`` ends it."""
        state = codecs.getincrementaldecoder("utf-8")("replace")

        def feed(ids: list[int] | None) -> str:
            if ids is None:
                return state.decode(b"", True)
            return state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))
        return feed


class Shared:
    """A tokenizer file read by the driver and sent to the tasks (its size is
    the file's); each worker builds the tables once."""

    _built: dict[int, Bpe] = {}

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            self.data = spark.sparkContext.broadcast((f.read(), pattern))

    def get(self) -> Bpe:
        source = self.data.value
        key = hash(source)
        if key not in Shared._built:
            Shared._built.clear()
            Shared._built[key] = Bpe(*source)
            spare_collector()
        return Shared._built[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """``docs`` with ``text`` replaced by the array of its ids.

    A null or empty text has no ids. Repeated rows stay, extra columns are
    carried, one named like ``tokens`` is replaced; an empty table stays empty.
    """
    field = T.StructField(tokens, T.ArrayType(T.IntegerType()))
    return over_text(docs, text, Shared(docs.sparkSession, path, pattern), [field],
                      lambda c, t: (list(chain.from_iterable(c.encode(t))),))


def decode(rows: DataFrame, path: str, pattern: str, tokens: str = "tokens", text: str = "text") -> DataFrame:
    """``rows`` with ``tokens`` replaced by their text; ill-formed UTF-8 becomes
    U+FFFD; null or empty ids give the empty text."""
    def one(coder: Bpe, ids) -> tuple[str]:
        feed = coder.decoder()
        return (feed(list(ids)) + feed(None) if ids else "",)

    return over_text(rows, tokens, Shared(rows.sparkSession, path, pattern),
                      [T.StructField(text, T.StringType())], one)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by ``n_tokens, ids_sha256,
    decoded_sha256``, block by block: neither the ids nor the decoded text of a
    long document are held whole. Cases as in ``encode``."""
    def one(coder: Bpe, body: str) -> tuple[int, str, str]:
        ids_sha, text_sha, n, feed = hashlib.sha256(), hashlib.sha256(), 0, coder.decoder()
        name = coder.text_of.__getitem__
        for ids in coder.encode(body):
            if ids:
                ids_sha.update((b"," if n else b"") + b",".join(map(name, ids)))
                text_sha.update(feed(ids).encode())
                n += len(ids)
        text_sha.update(feed(None).encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return over_text(docs, text, Shared(docs.sparkSession, path, pattern), fields, one)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)
