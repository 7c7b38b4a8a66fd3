"""Phrase / all-words matching, rank, headline (FIXTURES C + properties)."""

import pytest
from pyspark.sql import functions as F

from quire.operators.analysis import analyze, bind_query
from quire.operators.headline import headline, with_headline
from quire.operators.matching import (all_words_match, all_words_match_postings,
                                      phrase_match, phrase_match_postings, term_table)
from quire.operators.paragraphs import book_paragraphs
from quire.operators.postings import postings
from quire.operators.ranking import cover_density_rank
from quire.sources.tables import books

from conftest import SF_SMALL


def paras(spark, texts, lang="english"):
    return spark.createDataFrame([(i, 0, t, lang) for i, t in enumerate(texts)],
                                 "num long, para int, paragraph string, language string")


def matches(spark, query, texts):
    q = bind_query(spark, query, "english")
    return {r.num: r.n_matches for r in phrase_match(paras(spark, texts), q).collect()}


def test_phrase_over_stopword(spark):
    assert matches(spark, "cat to dog", ["cat the dog", "cat dog", "a cat of a dog"]) == {0: 1}


def test_repeated_word_counts_offsets(spark):
    assert matches(spark, "x y x", ["x y x y x"]) == {0: 2}


def test_stopword_only_query_matches_nothing(spark):
    assert matches(spark, "to be or not to be", ["to be or not to be"]) == {}


def test_all_words_any_order(spark):
    q = bind_query(spark, "dog cat", "english")
    got = all_words_match(paras(spark, ["the dogs chased a cat", "cat only"]), q).collect()
    assert [r.num for r in got] == [0]


def test_rank_values(spark):
    q_gap = bind_query(spark, "cat to dog", "english")
    q_adj = bind_query(spark, "cat dog", "english")
    df = spark.createDataFrame([(1,)], "n long")
    r1 = df.select(cover_density_rank(F.col("n"), q_gap).alias("r")).first().r
    r2 = df.select(cover_density_rank(F.col("n"), q_adj).alias("r")).first().r
    assert round(r1 * 100, 4) == 4.7619 and round(r2 * 100, 4) == 9.0909


def test_headline_marks_tokens_not_regex_boundaries(spark):
    q = bind_query(spark, "b", "simple")
    df = spark.createDataFrame([("la Bäche b",)], "paragraph string")
    assert df.select(headline("paragraph", q).alias("h")).first().h == "la Bäche **b**"


def test_headline_without_markers_is_text(spark):
    q = bind_query(spark, "cat dog", "english")
    text = "Cats, dogs & a Cat-dog! 12 dog."
    df = spark.createDataFrame([(text,)], "paragraph string")
    h = df.select(headline("paragraph", q).alias("h")).first().h
    assert h.replace("**", "") == text and "**Cats**" in h and "**dog**" in h


def test_fragment_headline_keeps_window(spark):
    q = bind_query(spark, "needle", "english")
    words = " ".join(f"w{i}" for i in range(100))
    text = words + " needle " + words
    df = spark.createDataFrame([(text,)], "paragraph string")
    h = with_headline(df, "paragraph", q, mode="windows", words=10).first().h
    assert h == "w95 w96 w97 w98 w99 **needle** w0 w1 w2 w3 w4"
    two = spark.createDataFrame([("a b needle c d e f g h i j k l needle m",)], "paragraph string")
    h2 = with_headline(two, "paragraph", q, mode="windows", words=4).first().h
    assert h2 == "a b **needle** c d ... k l **needle** m"


@pytest.fixture(scope="module")
def small_paragraphs(spark):
    return book_paragraphs(books(spark, SF_SMALL)).where(F.col("language") == "english").cache()


def test_phrase_subset_of_all_words(spark, small_paragraphs):
    q = bind_query(spark, "attion to thanedble", "english")
    ph = {(r.num, r.para) for r in phrase_match(small_paragraphs, q).collect()}
    aw = {(r.num, r.para) for r in all_words_match(small_paragraphs, q).collect()}
    assert ph and ph <= aw


def test_postings_form_equals_scan_form(spark, small_paragraphs):
    q = bind_query(spark, "attion to thanedble", "english")
    scan = {(r.num, r.para, r.n_matches) for r in phrase_match(small_paragraphs, q).collect()}
    post = postings(analyze(small_paragraphs))
    got = phrase_match_postings(post, term_table(spark, q)).collect()
    assert {(r.num, r.para, r.n_matches) for r in got} == scan
    aw_scan = {(r.num, r.para) for r in all_words_match(small_paragraphs, q).collect()}
    aw_post = {(r.num, r.para) for r in all_words_match_postings(post, term_table(spark, q)).collect()}
    assert aw_scan == aw_post


def test_rare_first_equals_plain(spark, small_paragraphs):
    from quire.operators.analysis import query_terms
    from quire.operators.matching import phrase_match_rare_first
    an = analyze(small_paragraphs)
    qs = spark.createDataFrame([(1, "attion to thanedble"), (2, "x y x"), (3, "onre enat"), (4, "zzqq attion")],
                               "query_id long, query string")
    terms = query_terms(spark, qs, "english")
    freq = an.groupBy("lexeme").agg(F.count("*").alias("n"))
    plain = {tuple(r) for r in phrase_match_postings(an, terms).collect()}
    rare = {tuple(r) for r in phrase_match_rare_first(an, terms, freq).collect()}
    assert plain == rare and plain


def test_headline_fragment_limit_and_only_matches(spark):
    q = bind_query(spark, "needle", "english")
    two = spark.createDataFrame([("a b needle c d e f g h i j k l needle m",)], "paragraph string")
    h1 = with_headline(two, "paragraph", q, mode="windows", words=4, max_fragments=1).first().h
    assert h1 == "a b **needle** c d"
    qp = bind_query(spark, "cat to dog", "english")
    df = spark.createDataFrame([("dog cat the dog, cat dog",)], "paragraph string")
    all_marked = with_headline(df, "paragraph", qp).first().h
    only = with_headline(df, "paragraph", qp, only_matches=True).first().h
    assert all_marked == "**dog** **cat** the **dog**, **cat** **dog**"
    assert only == "dog **cat** the **dog**, cat dog"
    lead = spark.createDataFrame([(", cat a dog",)], "paragraph string")
    assert with_headline(lead, "paragraph", qp, only_matches=True).first().h == ", **cat** a **dog**"


def test_rare_first_with_no_terms(spark, small_paragraphs):
    from quire.operators.analysis import query_terms
    from quire.operators.matching import phrase_match_rare_first
    an = analyze(small_paragraphs)
    terms = query_terms(spark, [(1, "to be or not")], "english")
    freq = an.groupBy("lexeme").agg(F.count("*").alias("n"))
    assert phrase_match_rare_first(an, terms, freq).count() == 0
