"""Search roll-up, paging, discovery, index search and plan shape."""

import pytest
from pyspark.sql import functions as F

from quire.operators.postings import build_index, read_index
from quire.plans import search as S
from quire.sources.tables import books

from conftest import SF_SMALL

PHRASE = "attion to thanedble"


@pytest.fixture(scope="module")
def small_books(spark):
    return books(spark, SF_SMALL)


def test_fixture_counts(spark, small_books):
    m = S.phrase_matches(spark, small_books, PHRASE)
    agg = m.agg(F.sum("n_matches").alias("n"), F.countDistinct("num").alias("d")).first()
    assert (agg.n, agg.d) == (31, 29)


def test_pages_concatenate_to_full_order(spark, small_books):
    full = S.phrase_search(spark, small_books, PHRASE)
    order = [r.num for r in full.orderBy(F.col("rank").desc(), "num").collect()]
    pages = []
    for start in range(1, len(order) + 1, 7):
        pages += [r.num for r in S.page(full, 7, start).collect()]
    assert pages == order


def test_rollup_matches_unbounded_definition(spark):
    # many excerpts for one book: the bounded two-phase selection must give
    # the same text as sorting all of them
    rows = [(7, f"h{i:05d}" * 3, 0.5) for i in range(3000)]
    m = spark.createDataFrame(rows, "num long, h string, rank double")
    bk = spark.createDataFrame([(7, "a", "t")], "num long, author string, title string")
    got = S.rollup_books(m, bk, salt=8).first()
    expect = "  ..." + S.EXCERPT_SEPARATOR.join(sorted(r[1] for r in rows))[:S.EXCERPT_LIMIT] + "...  "
    assert got.relevant_paragraphs == expect and got.rank == 50.0


def test_discovery_is_seeded_and_bounded(spark, small_books):
    a = [r.num for r in S.discovery_search(spark, small_books, "onre enat", seed=1).collect()]
    b = [r.num for r in S.discovery_search(spark, small_books, "onre enat", seed=1).collect()]
    assert a == b and len(a) <= 30


def test_stopword_search_is_empty(spark, small_books):
    assert S.phrase_search(spark, small_books, "to be or not to be").count() == 0


def test_index_search_equals_scan_search(spark, small_books, tmp_dir):
    idx_paths = build_index(spark, small_books, tmp_dir + "/idx", buckets=64)
    idx = read_index(spark, tmp_dir + "/idx")
    scan = S.phrase_search(spark, small_books, PHRASE)
    via_index = S.index_phrase_search(spark, idx, small_books, PHRASE)
    cols = ["num", "relevant_paragraphs", "rank"]
    assert sorted(scan.select(cols).collect()) == sorted(via_index.select(cols).collect())
    # the postings scan lists only the lexemes' bucket directories of one
    # language and pushes the lexeme filter into the Parquet reader
    from quire.operators.postings import lexeme_filter
    post = idx["postings"].where(lexeme_filter(idx["postings"], "english", ["attion", "thanedble"], idx["buckets"]))
    plan = post._jdf.queryExecution().executedPlan().toString()
    import re
    parts = re.findall(r"PartitionFilters: \[[^\]]*\]", plan)[0]
    assert "(language" in parts and "= english)" in parts
    assert re.search(r"bucket#\d+ IN \(\d+,\d+\)", parts)  # folded to literals: directory pruning
    assert "PushedFilters: [In(lexeme, [attion,thanedble])]" in plan
    assert set(idx_paths) == {"paragraphs", "postings", "lexeme_stats", "layout"}


def test_search_plan_has_no_cartesian(spark, small_books):
    plan = S.phrase_search(spark, small_books, PHRASE)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_index_page_reads_its_books_only(spark, small_books, tmp_dir):
    build_index(spark, small_books, tmp_dir + "/idx2", blocks=16)
    idx = read_index(spark, tmp_dir + "/idx2")
    scan = S.page(S.phrase_search(spark, small_books, PHRASE), 4, 2)
    paged = S.index_phrase_page(spark, idx, small_books, PHRASE, limit=4, start=2)
    assert [tuple(r) for r in scan.collect()] == [tuple(r) for r in paged.collect()]
    missing = S.index_phrase_search(spark, idx, small_books, "attion zzqqxx")
    assert missing.count() == 0
    assert S.index_phrase_search(spark, idx, small_books, "to be or not to be").count() == 0
    assert S.index_phrase_search(spark, idx, small_books, "attion", "german").count() == 0
    # text enters the plan through the join with the page's broadcast book ids:
    # no exchange below that join carries the paragraph
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.index_phrase_page(spark, idx, small_books, PHRASE, limit=4)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.toString().splitlines()
    scan_at = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "paragraph#" in x)
    joins = [i for i, x in enumerate(lines[:scan_at]) if "BroadcastHashJoin" in x and "block#" in x]
    assert joins and not any("Exchange" in x and "Broadcast" not in x for x in lines[joins[-1]:scan_at])
    # nothing runs before the action
    ran = []
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    S.index_phrase_page(spark, idx, small_books, PHRASE, limit=4)
    ran = set(tracker.getJobIdsForGroup(None)) - before
    assert len(ran) <= 1  # at most Parquet's schema inference of the opened buckets


def test_result_independent_of_partitioning(spark, small_books):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            res = S.phrase_search(spark, small_books.repartition(int(n)), PHRASE)
            out.append(sorted(tuple(r) for r in res.collect()))
        assert out[0] == out[1] and out[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_index_discovery_equals_scan(spark, small_books, tmp_dir):
    build_index(spark, small_books, tmp_dir + "/idx3")
    idx = read_index(spark, tmp_dir + "/idx3")
    scan = S.discovery_search(spark, small_books, "onre enat", seed=7)
    via = S.index_discovery_search(spark, idx, small_books, "onre enat", seed=7)
    assert [tuple(r) for r in scan.collect()] == [tuple(r) for r in via.collect()]


def test_corpus_build(spark, tmp_dir):
    from quire.operators import mentions as MN
    from quire.operators.paragraphs import book_paragraphs
    from quire.plans.corpus import build_corpus
    from quire.sources.tables import read_table
    bk = books(spark, SF_SMALL)
    names = read_table(spark, SF_SMALL, "benchmark").select(F.col("text").alias("name")).distinct()
    out = build_corpus(spark, bk, names, tmp_dir + "/corpus")
    assert set(out) == {"books", "paragraphs", "postings", "lexeme_stats", "layout", "mentions"}
    stored = sorted(tuple(r) for r in spark.read.parquet(out["mentions"]).collect())
    direct = MN.mention_pairs(names, book_paragraphs(bk).where(F.col("language").isNotNull()), bk)
    assert stored == sorted(tuple(r) for r in direct.collect())
    assert spark.read.parquet(out["books"]).count() == bk.count()


def test_rollup_with_one_hot_excerpt(spark):
    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("num"), F.lit("same").alias("h"), F.lit(0.25).alias("rank"))
    more = spark.createDataFrame([(7, "z" * 20_000, 0.25), (8, "b", 1.0), (8, "a", 0.0), (8, "a", 0.5)],
                                 "num long, h string, rank double")
    bk = spark.createDataFrame([(7, "a", "t"), (8, None, "u")], "num long, author string, title string")
    out = S.rollup_books(rows.union(more), bk, salt=8)
    got = {r.num: (r.relevant_paragraphs, r.rank) for r in out.collect()}
    body = ("same" + S.EXCERPT_SEPARATOR + "z" * 20_000)[:S.EXCERPT_LIMIT]
    assert got[7] == ("  ..." + body + "...  ", 25.0)
    assert got[8] == ("  ...a" + S.EXCERPT_SEPARATOR + "b...  ", 50.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(rank" in plan  # combined on the map side, before the salt


def test_lexeme_stats_without_exchanging_positions(spark, small_books):
    from quire.operators.analysis import analyze
    from quire.operators.paragraphs import book_paragraphs
    from quire.operators.postings import lexeme_stats, paragraph_stats, postings
    stats = paragraph_stats(book_paragraphs(small_books))
    assert stats._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    plain = lexeme_stats(postings(analyze(book_paragraphs(small_books))))
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, plain.collect()))


def test_plan_shapes(spark, small_books):
    from quire.operators.analysis import analyze
    from quire.operators.paragraphs import book_paragraphs
    an = analyze(book_paragraphs(small_books))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in an  # analysis is one narrow pass
    rs = S.phrase_search(spark, small_books, PHRASE)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(num" in rs and "bucket" in rs  # salted per-book roll-up
    assert rs.count("FileScan parquet") == 2  # text scanned once, metadata once


def test_index_search_headline_options(spark, small_books, tmp_dir):
    build_index(spark, small_books, tmp_dir + "/idx4")
    idx = read_index(spark, tmp_dir + "/idx4")
    cols = ["num", "relevant_paragraphs", "rank"]
    for kw in ({"only_matches": True}, {"mode": "fragments"}):
        scan = S.phrase_search(spark, small_books, PHRASE, **kw)
        via = S.index_phrase_search(spark, idx, small_books, PHRASE, **kw)
        assert sorted(scan.select(cols).collect()) == sorted(via.select(cols).collect())
