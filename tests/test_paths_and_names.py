"""Weighted paths by distance buckets, start picked from the graph, the name trie."""

import pytest
from pyspark.sql import functions as F

from quire.operators import graph as G
from quire.operators import mentions as MN


def test_weighted_path_settles_near_nodes_first(spark):
    edges = spark.createDataFrame([("a", "b", 10), ("a", "c", 1), ("c", "b", 2), ("b", "e", 1), ("c", "d", 2), ("d", "e", 1),
                                   ("x", "y", 1), ("a", "a", 1), ("e", "d", 1)], "a string, b string, w int")
    rows = [tuple(r) for r in G.weighted_path(spark, edges, "a", "e", "w").orderBy("step").collect()]
    assert rows == [(0, "a", 0.0), (1, "c", 1.0), (2, "b", 3.0), (3, "e", 4.0)]  # a tie of b and d: the smaller
    assert [tuple(r) for r in G.weighted_path(spark, edges, "a", "a", "w").collect()] == [(0, "a", 0.0)]
    assert G.weighted_path(spark, edges, "a", "y", "w").count() == 0
    assert G.weighted_path(spark, edges, "nobody", "a", "w").count() == 0
    with pytest.raises(ValueError):
        G.weighted_path(spark, edges.withColumn("w", F.col("w") - 1), "a", "e", "w")


def test_bfs_from_a_node_of_the_graph(spark):
    adj = G.adjacency(spark.createDataFrame([("b", "a"), ("b", "c"), ("a", "d"), ("c", "d")], "a string, b string"))
    got = {r["node"]: (r["hops"], r["path"]) for r in G.bfs(spark, adj, lambda nodes: nodes.agg(F.max("node").alias("node"))).collect()}
    assert got == {"d": (0, ["d"]), "a": (1, ["d", "a"]), "c": (1, ["d", "c"]), "b": (2, ["d", "a", "b"])}


@pytest.mark.parametrize("bits, firsts", [(1 << 18, 1 << 16), (64, 1)])  # the second lets everything through
def test_name_trie_against_every_run(spark, monkeypatch, bits, firsts):
    monkeypatch.setattr(MN, "BITS", bits)
    monkeypatch.setattr(MN, "FIRSTS", firsts)
    names = ["Ann", "ann lee", "A b c d e", "a B c d", "Zürich", "b, c!", "no body", "?!", "a b c d x", "e"]
    texts = ["Ann Lee a b c d e", "in zürich; B c d", "", None, "a b c d", "lee ann", "E"]
    paras = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "num long, para int, paragraph string")
    got = {(r["name"], r["num"]) for r in MN.name_hits(spark.createDataFrame([(n,) for n in names], "name string"), paras).collect()}
    import re
    words = lambda s: re.findall(r"\w+", (s or "").lower())
    want = {(n, i) for n in names for i, t in enumerate(texts) if words(n) and f" {' '.join(words(n))} " in f" {' '.join(words(t))} "}
    assert got == want and len(want) > 10
    assert MN.name_hits(spark.createDataFrame([("?",)], "name string"), paras).collect() == []
