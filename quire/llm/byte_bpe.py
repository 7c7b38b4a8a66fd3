"""Byte-level BPE by ranks: a lazily determinised finite-state transducer.

The merges are compiled into a nondeterministic machine that reads a text byte
by byte. One of its states is a token begun after a given token: a node of the
vocabulary's spelling automaton and the token before. A byte goes on to the
next node; where a token ends that can follow the one before (``merges``), a
new token begins. The set of these states after a prefix is one state of the
determinised machine: it is built when a text first reaches it and found by its
contents from then on. Its output is the token that ends the prefix. All chains
that can go on begin within one longest token of the byte just read; followed
back they meet, and the tokens before that point are emitted: no later byte
changes them. States beyond ``STATES`` start a new machine from the same merges,
so memory is constant in the length and number of texts.

Text is cut by the pattern first, each match is run from the start state, and
outputs of matches met again come from a bounded table. Decoding joins the
tokens' bytes and passes them through an incremental UTF-8 machine whose state
is the unfinished character, at most three bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quire.llm.common import over_text, table
from quire.llm.merges import Machine, Merges, Table, spare_collector

#: Bytes of a match read between two emissions, and characters of a text looked
#: at together.
BLOCK = 1 << 12
PART = 1 << 18

_CUT = regex.compile(r"(?<=\S)(?=\s)")


def rank_rules(ranks: dict[bytes, int]) -> tuple[list[tuple[int, int, int]], dict[bytes, int]]:
    """Merge rules in rank order, and the tokens that no merge ever makes.

    A token's rule joins the two parts that the ranks below its own leave of it.
    """
    rules, whole = [], {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i: i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            rules.append((ranks[parts[0]], ranks[parts[1]], rank))
        else:
            whole[token] = rank
    return rules, whole


class ByteBpe:
    """A vocabulary of byte ranks with its splitting pattern."""

    def __init__(self, source: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines()) if a}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no token")
        rules, self.whole = rank_rules(ranks)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: b"%d" % i for i in self.bytes_of}
        self.machine = Machine(Merges(rules, self.bytes_of))
        self.pattern = regex.compile(pattern)
        self.table = Table(self.match)

    def run(self, data: bytes) -> Iterator[list[int]]:
        """Tokens of one match as they become certain."""
        m, state, said = self.machine, 0, []
        for at in range(0, len(data), BLOCK):
            state = m.read(state, data[at: at + BLOCK], said)
            if at + BLOCK < len(data):
                cut = m.certain(said, state)
                yield m.chain(said, cut)
                del said[:cut]
        yield m.chain(said, len(said))

    def match(self, text: str) -> Iterable[int]:
        """Ids of one match of the pattern, lazily."""
        data = text.encode("utf-8", "replace")
        token = self.whole.get(data)
        return [token] if token is not None else chain.from_iterable(self.run(data))

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text``, part by part; special tokens in it are plain text."""
        at, end = 0, len(text)
        while at < end:
            # no match holds a non-space followed by a space
            cut = _CUT.search(text, min(at + PART, end)) if at + PART < end else None
            stop = cut.start() if cut else end
            yield list(chain.from_iterable(map(self.table.__getitem__, self.pattern.findall(text, at, stop))))
            at = stop

    def join(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Utf8:
    """Incremental decoding: ``feed`` bytes, get the finished characters.

    The state is the start of a character whose other bytes haven't come.
    Ill-formed bytes become U+FFFD, however the bytes are cut up.
    """

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        cut = len(data) if last else self.finished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def finished(data: bytes) -> int:
        """Bytes before the unfinished character at the end."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:  # a first byte: 110, 1110 or 11110 in front
                size = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return len(data) - back if back < size else len(data)
            if b < 0x80:
                break
        return len(data)


class Shared:
    """A rank file read by the driver and sent to the tasks (its size is the
    file's); each worker compiles it once."""

    _built: dict[int, ByteBpe] = {}

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.data = spark.sparkContext.broadcast((f.read(), pattern))

    def get(self) -> ByteBpe:
        source = self.data.value
        key = hash(source)
        if key not in Shared._built:
            Shared._built.clear()
            Shared._built[key] = ByteBpe(*source)
            spare_collector()
        return Shared._built[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """``docs`` with ``text`` replaced by the array of its ids.

    A null or empty text has no ids; a text of any length is read in parts.
    Repeated rows stay and are encoded alike, extra columns are carried, one
    named like ``tokens`` is replaced; an empty table stays empty.
    """
    field = T.StructField(tokens, T.ArrayType(T.IntegerType()))
    return over_text(docs, text, Shared(docs.sparkSession, path, pattern), [field],
                     lambda c, t: (list(chain.from_iterable(c.encode(t))),))


def decode(rows: DataFrame, path: str, pattern: str, tokens: str = "tokens", text: str = "text") -> DataFrame:
    """``rows`` with ``tokens`` replaced by their text.

    Null or empty ids give the empty text, ill-formed UTF-8 U+FFFD; an id that
    is no token is an error. Repeated rows stay, extra columns are carried, one
    named like ``text`` is replaced; an empty table stays empty.
    """
    def one(coder: ByteBpe, ids) -> tuple[str]:
        return (Utf8().feed(coder.join(ids), True) if ids else "",)

    return over_text(rows, tokens, Shared(rows.sparkSession, path, pattern),
                     [T.StructField(text, T.StringType())], one)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by ``n_tokens, ids_sha256, decoded_sha256``.

    Part by part: neither the ids nor the decoded text of a long document are
    held whole. Cases as in ``encode``.
    """
    def one(coder: ByteBpe, body: str) -> tuple[int, str, str]:
        ids_sha, text_sha, n, utf8 = hashlib.sha256(), hashlib.sha256(), 0, Utf8()
        name = coder.text_of.__getitem__
        for ids in coder.encode(body):
            if ids:
                ids_sha.update((b" " if n else b"") + b" ".join(map(name, ids)))
                text_sha.update(utf8.feed(coder.join(ids)).encode())
                n += len(ids)
        text_sha.update(utf8.feed(b"", True).encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return over_text(docs, text, Shared(docs.sparkSession, path, pattern), fields, one)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
