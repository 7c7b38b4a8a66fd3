"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_data import awkward
from quire.llm import spelling_variants as V
from quire.llm.common import table

from conftest import SF_ORACLE


def brute(docs):
    """Rows (word, form, root, n, n_near, form_n) of lists of (doc_id, text)."""
    n = Counter()
    for i, text in docs:
        for run in re.findall(V.RUN, text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    # a word with one place open, or left out: near words share one
    by = defaultdict(set)
    for w in n:
        for p in range(len(w)):
            by[w[:p] + "?" + w[p + 1:]].add(w)
            by[w[:p] + w[p + 1:]].add(w)
        by[w].add(w)
    near = defaultdict(set)
    for shape, group in by.items():
        for a in group:
            for b in group:
                if a != b and ("?" in shape or shape in (a, b)):
                    near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def rows(df):
    return sorted([tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()], key=repr)


@pytest.mark.parametrize("symbols", [1, 4, 30])
def test_random_words(spark, monkeypatch, symbols):
    monkeypatch.setattr(V, "SYMBOLS", symbols)
    monkeypatch.setattr(V, "BLOCK", 200)
    monkeypatch.setattr(V, "HELD", 50)
    rnd = random.Random(symbols)
    words = ["".join(rnd.choices("abÿé", k=rnd.randint(5, 6))) for _ in range(150)]
    docs = [(i, " ".join(w.upper() if rnd.random() < 0.1 else w for w in rnd.choices(words, weights=range(1, 151), k=60))) for i in range(40)]
    want = brute(docs)
    assert sum(r[4] for r in want) > 100 and any(r[1] and r[2] != r[1] for r in want)
    assert rows(V.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == want


def test_chains_of_forms_and_ties(spark):
    text = "abcde " * 3 + "abcdf " * 6 + "abcxf " * 12 + "abyxf " * 24 + "zbcdf " * 12 + "lone5words " * 9
    got = {r["word"]: r for r in V.spelling_variants(spark.createDataFrame([(None, text)], "doc_id long, text string")).collect()}
    assert got["abcde"]["form"] == "abcdf" and got["abcde"]["root"] == "abyxf"
    assert (got["abcdf"]["form"], got["abcdf"]["form_n"], got["abcdf"]["n_near"]) == ("abcxf", 12, 3)  # a tie with zbcdf
    assert got["words"]["form"] is None and got["words"]["root"] == "words" and got["words"]["n_near"] == 0


def test_one_long_run_and_a_hot_form(spark):
    long = "x" * 4000
    hot = [a + b + "tail" for a in "bcdfgh" for b in "aeiou"]
    docs = [(None, " ".join([long, long[:-1] + "y", long + "z"] + hot)) for _ in range(3)]
    assert rows(V.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_keys_meet_for_every_edit():
    rnd = random.Random(2)
    for _ in range(400):
        w = "".join(rnd.choices("abcdeÿ", k=rnd.randint(5, 11)))
        at, kind = rnd.randrange(len(w)), rnd.choice("dri")
        other = w[:at] + ("" if kind == "d" else rnd.choice("abcdeÿ")) + w[at + (kind != "i"):]
        own, around = (lambda x: set(V.own_keys(V.Reduced([x]))[1].tolist())), (lambda x: set(V.neighbour_keys(V.Reduced([x]))[1].tolist()))
        assert around(w) & own(other) or around(other) & own(w)
    assert len(np.unique(V.own_keys(V.Reduced(["abcde", "abcdf"]))[1])) >= 3


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    held = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = V.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(got) == brute(held)
    assert rows(V.spelling_variants(docs.limit(0))) == [] == rows(V.spelling_variants(docs.where("text is null")))


def test_query_against_all_words(spark):
    from quire.llm.registry import queries

    docs = [tuple(r) for r in table(spark, SF_ORACLE, "documents").select("doc_id", "text").collect()]
    want = brute(docs)
    assert sum(1 for r in want if r[1]) > 20
    assert rows(queries()["op12_spelling_variants"](spark, SF_ORACLE)) == want
