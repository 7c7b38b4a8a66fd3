"""Ranked lexical search against a score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_data import awkward
from oracle_check import compare, duck_connection
from quire.llm import lexical_search as L

from conftest import SF_ORACLE, SF_SMALL

_PATTERN = re.compile(L.TERM)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, queries, top):
    """(place of the query, rank, doc_id, score) of lists of (id, text)."""
    held = [(i, _PATTERN.findall(lowered(t))) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out = []
    for at, (item, text) in enumerate(queries):
        wanted, scored = set(_PATTERN.findall(lowered(text))), []
        for i, t in held:
            tf, m = Counter(t), 100 - 50 + (50 * len(t) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10 ** 9 * tf[x]) // (1000 * tf[x] + 20 * m))
                        for x in wanted if x in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("step", [0.5, 0.9])
def test_nra_is_a_full_sort(step, monkeypatch):
    monkeypatch.setattr(L, "STEP", step)
    rnd = np.random.default_rng(4)
    for trial in range(300):
        docs, k, lists, total = int(rnd.integers(1, 60)), int(rnd.integers(1, 12)), [], None
        total = np.zeros(docs, np.int64)
        for _ in range(rnd.integers(0, 9)):
            d = rnd.permutation(docs)[: rnd.integers(0, docs + 1)]
            s = np.sort(rnd.integers(0, [3, 50, 10 ** 6][trial % 3], len(d)))[::-1]
            total[d] += s
            lists.append((d, s))
        want = [i for i in np.lexsort((np.arange(docs), -total)) if total[i] > 0][:k]
        got, scores = L.nra(lists, docs, k)
        assert got.tolist() == want and scores.tolist() == total[want].tolist()


@pytest.mark.parametrize("block, terms", [(1 << 21, 1 << 18), (40, 5)])
def test_small_tables_in_any_blocks(spark, monkeypatch, block, terms):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "QUERY_TERMS", terms)
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefgh") * rnd.choice([1, 1, 2]) if rnd.random() < 0.9 else rnd.choice(["É", "x9", "Zürich", "漢字"])
    docs = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 5, 30])))) for i in range(120)]
    docs += [(3, "a b c"), (3, "a b c"), (None, "a a É"), (None, None), (500, None), (501, ".. --"), (502, "A A a")]
    queries = [(i, " ".join(word() for _ in range(rnd.choice([1, 4, 9])))) for i in range(12)]
    queries += [(1, "A b"), (None, "c C"), (77, None), (78, "?!"), (79, "nowhere")]
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                   spark.createDataFrame(queries, "item_id long, text string"), 7)
    assert rows(got) == brute(docs, queries, 7)


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    asked = [(1, "fox brown shared3 word17"), (2, "SAME one")]
    queries = spark.createDataFrame([(i, t, 0) for i, t in asked], "item_id long, text string, rank int")
    held = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows(L.search(docs, queries)) == brute(held, asked, L.TOP)
    assert rows(L.search(docs.limit(0), queries)) == [] == rows(L.search(docs, queries.limit(0)))
    assert rows(L.search(docs.where("text is null"), queries)) == []


@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_query_against_sql(spark, sf):
    ok, detail = compare(spark, sf, "op13_lexical_search", duck_connection(sf), verbose=False)
    assert ok and len(detail[1]) == len(detail[3]) > 1000
