"""Findings of round 4: what they asked for, on rows of their own."""

from __future__ import annotations

import gzip
import random

from pyspark.sql import functions as F

from quire.llm import simhash_dedup
from quire.operators import matching as MT
from quire.operators import mentions as MN
from quire.operators.analysis import analyze, query_terms
from quire.sources import files as FS


def _ran(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_and_balls_are_not_broadcast(spark):
    fps = [7, 6, 6 | 1 << 40, 1 << 50, -1]
    edges = simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {frozenset((r["u"], r["v"])) for r in edges.collect()}
    assert got == {frozenset(p) for p in ((7, 6), (7, 6 | 1 << 40), (6, 6 | 1 << 40), (6, 1 << 50))}
    assert _ran(edges).count("Broadcast") == 0 and "SortMergeJoin" in _ran(edges)


def _texts(spark, rng, n):
    rows = [(rng.choice([1, 2, 3, 4, None]), i, rng.choice(["english", "german", None]),
             " ".join(rng.choice(["cat", "cats", "dog", "the", "of", "tree", "und", "sea"]) for _ in range(rng.randint(0, 30)))) for i in range(n)]
    return spark.createDataFrame(rows + rows[: n // 2], "num long, para int, language string, paragraph string"), rows


def test_rare_first_with_repeated_paragraphs_and_many_terms(spark, monkeypatch):
    rng = random.Random(4)
    paras, rows = _texts(spark, rng, 24)
    other = spark.createDataFrame([(9, 0, "english", "cat dog tree"), (9, 0, "english", "sea cat dog")], paras.schema)
    once = analyze(spark.createDataFrame(rows, paras.schema))
    qs = [(1, "cat of dog"), (2, "dog"), (3, "the cat cat"), (4, "sea tree dog und"), (5, "nowhere cat"), (6, "dog cat dog the sea")]
    terms = query_terms(spark, qs, "english")
    want = {tuple(r) for r in MT.phrase_match_postings(once, terms).where("num IS NOT NULL").collect()}
    for few in (1 << 20, 0):
        monkeypatch.setattr(MT, "FEW_TERMS", few)
        for an in (once, analyze(paras)):  # repeated rows are one paragraph's, and failed before
            assert {tuple(r) for r in MT.phrase_match_rare_first(an, terms).collect()} == want and want
        both = MT.phrase_starts_rare_first(analyze(other), query_terms(spark, [(1, "cat dog tree"), (2, "cat dog")], "english"))
        assert {tuple(r) for r in both.collect()} >= {(1, 9, 0, 0), (2, 9, 0, 0), (2, 9, 0, 1)}


def test_mentions_shuffle_positions_once(spark):
    rng = random.Random(5)
    paras, rows = _texts(spark, rng, 30)
    names = spark.createDataFrame([("Cat Of Dog",), ("dog",), ("cat dog",), ("Cats dog",), ("of the",), (None,), ("dog",)], "name string")
    books = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "A"), (3, None), (4, "B"), (None, "C")], "num long, author string")
    hits = {(r["query_id"], r["num"]) for lang in ("english", "german") for r in MT.phrase_match_postings(
        analyze(spark.createDataFrame([x for x in rows if x[2] == lang], paras.schema)),
        query_terms(spark, [(i, n) for i, n in enumerate(["Cat Of Dog", "dog", "cat dog", "Cats dog"])], lang)).collect()}
    found = {}
    for i, name in enumerate(["Cat Of Dog", "dog", "cat dog", "Cats dog"]):
        for num, author in ((1, "A"), (1, "B"), (2, "A"), (4, "B")):
            if (i, num) in hits:
                found.setdefault((name, author), set()).add(num)
    got = MN.mention_pairs_postings(names, analyze(paras), books)
    rows = [tuple(r) for r in got.collect()]
    assert rows == sorted(((a, b, len(n)) for (a, b), n in found.items()), key=lambda r: (-r[2], r[0], r[1])) and rows
    starts = MT.phrase_starts_rare_first(analyze(paras), query_terms(spark, [(1, "cat of dog")], "english"))
    starts.collect()
    plan = _ran(starts).split("Initial Plan")[0]
    assert sum("Exchange hashpartitioning(num" in x for x in plan.splitlines()) == 1 and "SortMergeJoin" not in plan


def test_one_listing_serves_contents_and_report(spark, tmp_path, monkeypatch):
    root = tmp_path / "files"
    (root / "a b").mkdir(parents=True)
    texts = {"a b/1.txt": b"one\n\n", "2.txt": "zwei é".encode(), "odd.txt": b"\xff\xfe x\n", "none.txt": b"", "left.txt": b"u"}
    for path, text in texts.items():
        (root / path).write_bytes(text)
    meta = spark.createDataFrame([(1, "a b/1.txt"), (2, "2.txt"), (3, "odd.txt"), (4, "none.txt"), (5, "gone.txt"), (6, "6.txt.gz"), (2, "2.txt")],
                                 "num long, gd_path string")
    want = {(1, b"one\n"), (2, "zwei é".encode()), (3, "\ufffd\ufffd x".encode()), (4, b""), (5, b""), (6, b"")}

    def rows(df):
        return sorted((r["num"], bytes(r["c"])) for r in df.select("num", F.col("content").cast("binary").alias("c")).collect())

    listing = FS.list_files(spark, str(root))
    got = FS.read_contents(spark, meta, str(root), listing=listing)
    assert rows(got) == sorted([*want, (2, "zwei é".encode())])
    assert _ran(got).split("Initial Plan")[0].count("Scan binaryFile") == 1 and "Scan text" not in _ran(got)
    report = FS.content_report(spark, meta, str(root), listing=listing)
    assert {(r["num"], r["rel_path"], r["status"]) for r in report.collect()} == {
        (4, "none.txt", "empty"), (5, "gone.txt", "missing"), (6, "6.txt.gz", "missing"), (None, "left.txt", "unlisted")}
    assert "Scan binaryFile" not in _ran(report)
    (root / "6.txt.gz").write_bytes(gzip.compress(b"six\n"))  # decompressed, as before
    monkeypatch.setattr(FS, "MOST_PATHS", 0)
    for again in (None, FS.list_files(spark, str(root))):
        assert rows(FS.read_contents(spark, meta, str(root), listing=again)) == sorted([*(want - {(6, b"")}), (6, b"six"), (2, "zwei é".encode())])
