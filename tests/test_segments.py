"""Lists of frequent pairs, and an index that follows its text."""

import itertools

import pytest

from quire.operators import segments as SG
from quire.operators.analysis import bind_query
from quire.operators.paragraphs import split_paragraphs
from quire.operators.postings import build_index, read_index
from quire.plans import search as S

BOOK = "num long, author string, language string, title string, length long, content string"


def books(spark, texts, language="English"):
    return spark.createDataFrame([(n, "a", language, f"T{n}", len(t), t) for n, t in texts], BOOK)


def hits(spark, path, query, phrase=True):
    idx = read_index(spark, path)
    rows = S.index_hits(spark, idx, bind_query(spark, query, "english"), phrase)
    return sorted((r["num"], r["para"]) + ((r["n_matches"],) if phrase else ()) for r in rows.collect())


def test_pairs_find_what_single_lists_find(spark, tmp_dir):
    words = ["sea", "wind", "to", "ship", "rare"]
    texts = [(i, " ".join(w) + " sea wind ship sea.\nsea sea sea") for i, w in enumerate(itertools.permutations(words, 4))]
    texts = [(n, t if n % 40 == 0 else t.replace("rare", "x%d" % n)) for n, t in texts]
    corpus = books(spark, texts)
    build_index(spark, corpus, f"{tmp_dir}/plain")
    build_index(spark, corpus, f"{tmp_dir}/pairs", pair_share=0.2)
    frequent = read_index(spark, f"{tmp_dir}/pairs")["frequent"]["english"]
    assert frequent == ["sea", "ship", "wind"]
    for query in ("sea to wind", "sea sea sea", "rare sea", "sea wind rare", "wind to sea wind ship"):
        assert hits(spark, f"{tmp_dir}/pairs", query) == hits(spark, f"{tmp_dir}/plain", query), query
    q = bind_query(spark, "sea wind to rare ship sea", "english")
    assert S.phrase_lists(q, frequent) == ([("sea wind 1", 0), ("ship sea 1", 4)], [("rare", 3)])


@pytest.mark.parametrize("kind", [{}, {"pair_share": 0.3}, {"stemmed": True}])
def test_append_delete_add_again_and_merge(spark, tmp_dir, kind):
    path = f"{tmp_dir}/index"
    corpus = books(spark, [(1, "old ship sails.\nnew ship"), (2, "old ship sails.\nold ship sinks"), (3, "a ship")])
    build_index(spark, corpus, path, **kind)

    def found(at=path):
        res = S.index_phrase_search(spark, read_index(spark, at), corpus, "old ship", mode="full")
        return sorted((r["num"], r["relevant_paragraphs"].count("**") // 4) for r in res.collect())

    def stats(at=path):
        rows = read_index(spark, at)["lexeme_stats"].collect()
        return {r["lexeme"]: (r["paragraphs"], r["occurrences"]) for r in rows}

    assert found() == [(1, 1), (2, 2)]
    more = spark.createDataFrame([(3, 7, "english", "old ship, old ship", 18), (3, 8, None, "old ship", 8)],
                                 "num long, para int, language string, paragraph string, paragraph_length int")
    assert SG.append_paragraphs(spark, path, more) == 1
    assert found() == [(1, 1), (2, 2), (3, 2)] and stats()["old"] == (4, 5)
    keys = spark.createDataFrame([(2, 1), (3, 7), (9, 9)], "num long, para int")
    assert SG.delete_paragraphs(spark, path, keys) == 2
    assert found() == [(1, 1), (2, 1)] and stats()["old"] == (2, 2)
    again = spark.createDataFrame([(3, 7, "english", "the old ship", 12)], more.schema)
    assert SG.append_paragraphs(spark, path, again) == 3
    assert found() == [(1, 1), (2, 1), (3, 1)] and stats()["old"] == (3, 3)
    words = S.index_discovery_search(spark, read_index(spark, path), corpus, "ship old").collect()
    assert sorted(r["num"] for r in words) == [1, 2, 3]
    SG.merge_index(spark, path, f"{tmp_dir}/merged", pair_share=kind.get("pair_share"))
    assert found(f"{tmp_dir}/merged") == found() and stats(f"{tmp_dir}/merged") == stats()
    assert read_index(spark, f"{tmp_dir}/merged")["paragraphs"].count() == read_index(spark, path)["paragraphs"].count() == 6


def test_deleting_everything(spark, tmp_dir):
    corpus = books(spark, [(1, "old ship")])
    build_index(spark, corpus, f"{tmp_dir}/i")
    SG.delete_paragraphs(spark, f"{tmp_dir}/i", split_paragraphs(corpus))
    idx = read_index(spark, f"{tmp_dir}/i")
    assert idx["paragraphs"].count() == idx["postings"].count() == idx["lexeme_stats"].count() == 0
