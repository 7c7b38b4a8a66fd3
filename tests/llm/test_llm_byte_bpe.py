"""Byte-level BPE by ranks, against the public library and one-shot decoding."""

import base64
import codecs
import hashlib
import random
from itertools import chain

import public_tokenizers as tokenizers
import pytest
import tiktoken

from llm_data import awkward
from quire.llm import byte_bpe, merges
from quire.llm.common import table

from conftest import SF_SMALL

PATH = tokenizers.path("byte_bpe_50k.tiktoken")


def _source():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(_source(), tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _source().splitlines())}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(coder, text):
    return list(chain.from_iterable(coder.encode(text)))


def test_random_texts_as_the_library(coder, library):
    rnd = random.Random(3)
    for _ in range(4000):
        letters = rnd.sample("abcdefghijklmnopqrstuvwxyz eaosth  \n\t'éü漢\U0001F600123-_=.,\x1c\x85​", rnd.choice([2, 4, 12, 40]))
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 60)))
        assert ids_of(coder, text) == library.encode_ordinary(text), text


def test_long_matches_and_small_parts(coder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 97)
    monkeypatch.setattr(byte_bpe, "BLOCK", 7)
    for text in ["x" * 5000, "=" * 999 + "-" * 333, " " * 3000 + "a", "\n" * 500 + " " * 500, "ab" * 900,
                 "ahaha" * 700, "<|endoftext|> don't " * 50, "漢字" * 400]:
        assert ids_of(coder, text) == library.encode_ordinary(text), text[:9]


def test_restart_of_the_machine(library, monkeypatch):
    monkeypatch.setattr(merges, "STATES", 50)
    monkeypatch.setattr(byte_bpe, "BLOCK", 16)
    monkeypatch.setattr(merges, "TABLE_BYTES", 3000)
    small = byte_bpe.ByteBpe(_source(), tokenizers.PATTERN)
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(1, 90))) for _ in range(400))
    assert ids_of(small, text) == library.encode_ordinary(text)
    assert len(small.machine.items) < 500


def test_neighbours_are_what_encoding_both_gives(coder, library):
    rnd = random.Random(7)
    spelled = coder.bytes_of
    rules = coder.machine.merges
    for _ in range(20000):
        u, v = rnd.randrange(300), rnd.randrange(3000)
        both = spelled[u] + spelled[v]
        assert rules.apart(u, v) == (library._encode_single_piece(both) == [u, v])


def test_a_token_no_merge_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257}
    rules, whole = byte_bpe.rank_rules(ranks)
    assert rules == [(97, 98, 256)] and whole == {b"abcd": 257}
    assert len(merges.Merges(rules, {i: b for b, i in ranks.items()}).ends) == 257


def test_utf8_machine_however_cut():
    rnd = random.Random(11)
    good = "aé漢\U0001F600z".encode()
    for _ in range(3000):
        data = bytes(rnd.choice(good + b"\xe0\xf0\x80\xc2\xed\xa0\xff\xf4\x90") for _ in range(rnd.randint(0, 14)))
        utf8, out, at = byte_bpe.Utf8(), "", 0
        while at < len(data):
            step = rnd.randint(1, 4)
            out += utf8.feed(data[at: at + step])
            assert len(utf8.held) <= 3
            at += step
        assert out + utf8.feed(b"", True) == data.decode("utf-8", "replace")
        assert data.decode("utf-8", "replace") == codecs.getincrementaldecoder("utf-8")("replace").decode(data, True)


def test_round_trip_over_awkward_rows(spark):
    docs = awkward(spark)
    coded = byte_bpe.encode(docs, PATH, tokenizers.PATTERN)
    assert coded.columns == [c for c in docs.columns if c != "text"] + ["tokens"]
    back = byte_bpe.decode(coded, PATH, tokenizers.PATTERN)
    texts = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    assert texts(back) == texts(docs)
    assert byte_bpe.round_trip(docs.limit(0), PATH, tokenizers.PATTERN).count() == 0


def test_query_against_the_library(spark, library):
    from quire.llm.registry import queries

    got = {r["doc_id"]: tuple(r)[1:] for r in queries()["op11_byte_bpe"](spark, SF_SMALL)
           .select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    rows = table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))
