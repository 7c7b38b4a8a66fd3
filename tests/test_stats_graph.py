"""Statistics, quality checks, mentions and graph (FIXTURES C)."""

from pyspark.sql import functions as F

from quire.functions.text import rank_text, title_link
from quire.operators import graph as G
from quire.operators import mentions as MN
from quire.operators import paragraphs as PG
from quire.operators import quality as QA
from quire.operators import stats as ST


def book_rows(spark, rows):
    return spark.createDataFrame(rows, "num long, author string, language string, title string, length long")


def test_unsupported_languages_null_aware(spark):
    b = book_rows(spark, [(1, "a", "English", "t", 5), (2, "b", None, "t", 5), (3, "c", "Spanish", "t", 5)])
    assert ST.unsupported_languages(spark, b).first().languages == "Spanish"


def test_zero_length_excluded_from_hist(spark):
    b = book_rows(spark, [(1, "a", "English", "t", 0), (2, "b", "Dutch", "t", 1000)])
    rows = ST.book_length_hist(b).collect()
    assert [(r.language, r.bin, r.books) for r in rows] == [("Other", 12, 1)]


def test_books_per_language_order(spark):
    b = book_rows(spark, [(1, "a", "English", "t", 1), (2, "b", "Dutch", "t", 1), (3, "c", "Dutch", "t", 1),
                          (4, "d", "French", "t", 1), (5, "e", None, "t", 1)])
    rows = [(r.language, r.books, r.supported) for r in ST.books_per_language(b).collect()]
    assert rows == [("Dutch", 2, "No"), ("English", 1, "Yes"), ("French", 1, "Yes")]


def test_null_title_nulls_link_and_rank_text(spark):
    df = spark.createDataFrame([(1, None, 4.7619), (2, "T", 100.0)], "num long, title string, r double")
    rows = df.select(title_link(F.col("title"), F.col("num"), "b/").alias("l"),
                     rank_text(F.col("r")).alias("t")).collect()
    assert rows[0].l is None and rows[1].l == "[T](b/2)"
    assert rows[0].t == "  4.8" and rows[1].t == " ##.#"


def test_delete_keeps_null_length(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "paragraph_length int")
    assert sorted(r.paragraph_length or 0 for r in PG.prune_long(df, 5).collect()) == [0, 1]


def test_quality_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "num long")
    r = QA.check_unique(df, ["num"], "t").first()
    assert (r.rows, r.keys, r.duplicate_keys, r.null_key_rows) == (4, 3, 1, 1)
    parent = spark.createDataFrame([(1,)], "num long")
    r = QA.check_reference(df, parent, "num", "fk").first()
    assert (r.rows, r.orphans) == (4, 2)


def test_mentions_kgram_join(spark):
    names = spark.createDataFrame([("Cat Dog",), ("Bird",), ("x y z w",)], "name string")
    paras = spark.createDataFrame([(1, 0, "The cat dog. bird"), (2, 0, "cat bird dog"), (3, 0, "cat dog"), (3, 1, None)],
                                  "num long, para int, paragraph string")
    bk = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "num long, author string")
    pairs = MN.mention_pairs(names, paras, bk)
    got = sorted((r.mentioned_author, r.mentioned_by, r.books_mentioned_in) for r in pairs.collect())
    assert got == [("Bird", "A", 1), ("Bird", "B", 1), ("Cat Dog", "A", 1)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_mutual_mention_one_edge(spark):
    pairs = spark.createDataFrame([("a", "b", 2), ("b", "a", 3)],
                                  "mentioned_author string, mentioned_by string, books_mentioned_in long")
    rows = MN.mention_edges(pairs).collect()
    assert [(r.a, r.b, r.books_mentioned_in) for r in rows] == [("a", "b", 5)]


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "y")],
                                  "a string, b string")
    path = [r.node for r in G.shortest_path(spark, edges, "a", "e").orderBy("step").collect()]
    assert path == ["a", "b", "d", "e"]  # tie between a-b-d and a-c-d goes to the smaller
    assert [r.node for r in G.shortest_path(spark, edges, "a", "a").collect()] == ["a"]
    assert G.shortest_path(spark, edges, "a", "y").count() == 0
    assert G.shortest_path(spark, edges, "nobody", "a").count() == 0


def test_mentions_over_analysed_paragraphs(spark):
    from quire.operators.analysis import analyze
    names = spark.createDataFrame([("Cat of Dogs",), ("Bird",)], "name string")
    paras = spark.createDataFrame([(1, 0, "a cat the dogs flew", "english"), (2, 0, "Birds and birds", "english")],
                                  "num long, para int, paragraph string, language string")
    bk = spark.createDataFrame([(1, "A"), (2, "B")], "num long, author string")
    # names analysed like the paragraphs: stopword gap kept, plural stemmed
    got = MN.mention_pairs_postings(names, analyze(paras), bk).collect()
    assert sorted((r.mentioned_author, r.mentioned_by) for r in got) == [("Bird", "B"), ("Cat of Dogs", "A")]
    # the reference's mixed mode: a 'simple' name word that the paragraph
    # analyser drops ('of') or stems ('dogs') can never match; 'bird' can
    mixed = MN.mention_pairs_postings(names, analyze(paras), bk, name_config="simple").collect()
    assert [(r.mentioned_author, r.mentioned_by) for r in mixed] == [("Bird", "B")]


def test_paths_against_all_simple_paths(spark):
    """Two-sided search and BFS against every simple path of small graphs."""
    import random
    rng = random.Random(12)
    for _ in range(4):
        nodes = [f"n{i}" for i in range(8)]
        edges = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(9)})
        df = spark.createDataFrame([(a, b, float(rng.randint(1, 5))) for a, b in edges], "a string, b string, w double")
        w = {(r.a, r.b): r.w for r in df.collect()}
        w |= {(b, a): x for (a, b), x in w.items()}
        every = []

        def walk(path):
            every.append(path)
            for n in nodes:
                if (path[-1], n) in w and n not in path:
                    walk(path + [n])
        walk(["n0"])
        shortest = {}
        for p in every:
            shortest[p[-1]] = min(shortest.get(p[-1], (99, [])), (len(p), p))
        known = any("n0" in e for e in edges)
        got = {r.node: r.path for r in G.bfs(spark, G.adjacency(df), spark.createDataFrame([("n0",)], "node string")).collect()}
        assert got == ({n: p for n, (_, p) in shortest.items()} if known else {})
        for t in ("n3", "n7"):
            path = [r.node for r in G.shortest_path(spark, df, "n0", t).orderBy("step").collect()]
            assert path == (shortest[t][1] if t in shortest and known else [])
            heavy = [r.node for r in G.shortest_path(spark, df, "n0", t, weight="w").orderBy("step").collect()]
            cost = lambda p: sum(w[x] for x in zip(p, p[1:]))
            best = min((cost(p) for p in every if p[-1] == t), default=None)
            assert (cost(heavy) == best and heavy[0] == "n0" and heavy[-1] == t) if best is not None else heavy == []
