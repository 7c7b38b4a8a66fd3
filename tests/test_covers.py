"""Covers, their rank, and best fragments, case by case."""

import itertools
import random

import pytest

from quire.operators.analysis import bind_query
from quire.operators.covers import with_covers
from quire.operators.headline import with_headline
from quire.operators.ranking import covers_rank

WORDS = " ".join(f"word{i}" for i in range(100))


def covers(spark, text, query, phrase, cfg="simple"):
    q = bind_query(spark, query, cfg)
    row = with_covers(spark.createDataFrame([(text,)], "paragraph string"), "paragraph", q, phrase) \
        .select("covers", covers_rank().alias("rank")).first()
    return [tuple(c) for c in row["covers"]], row["rank"]


def headline(spark, text, query, phrase=True, cfg="simple", **kw):
    q = bind_query(spark, query, cfg)
    return with_headline(spark.createDataFrame([(text,)], "paragraph string"), "paragraph", q, "fragments",
                         phrase=phrase, **kw).first()["h"]


def test_phrase_covers_with_gaps_and_repeats(spark):
    got, rank = covers(spark, "alpha to beta alpha beta beta alpha alpha beta", "alpha to beta", True, "english")
    assert got == [(0, 2, 2), (3, 5, 3), (6, 8, 3)]  # a query word in the gap is no noise
    assert rank == pytest.approx(0.25 / 1.25)
    assert covers(spark, "x x x y x", "x x", True)[0] == [(0, 1, 2), (1, 2, 2)]
    assert covers(spark, "x y", "x x", True) == ([], 0.0)


def test_minimal_covers_by_definition(spark):
    rnd = random.Random(5)
    rows = [" ".join(rnd.choices("abcxyz", k=rnd.randint(0, 14))) for _ in range(60)] + [None, ""]
    q = bind_query(spark, "a c b", "simple")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, paragraph string")
    got = {r["id"]: [tuple(c) for c in r["covers"]] for r in with_covers(df, "paragraph", q, False).collect()}
    for i, text in enumerate(rows):
        w = (text or "").split()
        full = [(s, e) for s, e in itertools.combinations_with_replacement(range(len(w)), 2) if set("abc") <= set(w[s:e + 1])]
        least = [(s, e) for s, e in full if not any((s, e) != (a, b) and s <= a and b <= e for a, b in full)]
        assert got[i] == [(s, e, sum(x in "abc" for x in w[s:e + 1])) for s, e in least]


def test_a_fragment_is_stretched_to_35_words(spark):
    h = headline(spark, f"{WORDS} needle {WORDS}", "needle")
    left = " ".join(f"word{i}" for i in range(83, 100))
    right = " ".join(f"word{i}" for i in range(17))
    assert h == f"{left} **needle** {right}" and len(h.split()) == 35
    assert headline(spark, f"needle {WORDS}", "needle") == "**needle** " + " ".join(f"word{i}" for i in range(34))


def test_ends_are_drawn_back_to_longer_words(spark):
    assert headline(spark, "(a of some thing needle other of an", "needle") == "some thing **needle** other"
    assert headline(spark, "of it", "it") == "**it**"


def test_the_best_cover_comes_first_and_others_stay_apart(spark):
    text = f"tiger {WORDS} tiger or horse {WORDS} horse tiger horse"
    both = headline(spark, text, "tiger horse", phrase=False)
    assert both.count(" ... ") == 1 and both.endswith("**horse** **tiger** **horse**")
    one = headline(spark, text, "tiger horse", phrase=False, max_fragments=1)
    assert one.endswith("word99 **horse** **tiger** **horse**") and " ... " not in one  # two words, not three
    near = headline(spark, "needle aaaa bbbb needle cccc dddd eeee ffff gggg needle", "needle", words=4)
    assert near == "**needle** aaaa bbbb **needle** ... gggg **needle**"


def test_a_long_cover_is_cut_at_query_words(spark):
    h = headline(spark, f"cat, {WORDS} dog!", "cat dog", phrase=False)
    assert h == ("**cat**, " + " ".join(f"word{i}" for i in range(34)) + " ... " + " ".join(f"word{i}" for i in range(83, 100)) + " **dog**")


def test_no_cover_no_text_and_marks(spark):
    assert headline(spark, WORDS, "needle") == " ".join(f"word{i}" for i in range(15))
    assert headline(spark, "some text", "the", cfg="english") == "some text"
    assert headline(spark, None, "needle") is None and headline(spark, "", "needle") == "" and headline(spark, "?!", "needle") == ""
    text = "beta alpha to beta"
    assert headline(spark, text, "alpha to beta", cfg="english") == "**beta** **alpha** to **beta**"
    assert headline(spark, text, "alpha to beta", cfg="english", only_matches=True) == "beta **alpha** to **beta**"
