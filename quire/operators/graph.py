"""Shortest paths in the mention graph: breadth-first search with joins.

The frontier is a DataFrame ``(node, parent)``. Each hop joins it to the
adjacency list, drops nodes of the last two hops (in an undirected graph a
neighbour of hop k lies in k - 1, k or k + 1, so no older hop can come back),
keeps one parent per new node, and is written as a table, so the lineage stays
one hop long and a lost executor only recomputes one hop. The loop on the driver runs once per hop (at most the
graph's diameter); no node list or path set is collected.

A path between two names is searched from both ends, the smaller frontier
first. Edges are unweighted by default, as in the reference (its weight
attribute is never named in the path call); with a weight column nodes are
settled in buckets of distance. An unknown start or an unreachable target gives
an empty result instead of an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def adjacency(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Both directions of every edge, self-loops dropped: ``src, dst``."""
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where(F.col("src") != F.col("dst")).distinct()


def bfs(spark: SparkSession, adj: DataFrame, start: DataFrame | Callable[[DataFrame], DataFrame],
        target: str | None = None, max_hops: int | None = None) -> DataFrame:
    """``node, hops, path`` for every node reachable from ``start``.

    ``start`` is a one-column DataFrame ``node`` (one row; derived from the
    data, so nothing is passed through the driver), or a function that picks it
    from the graph's ``nodes`` (a written table, so the graph is computed once).
    Ties between shortest paths go to the lexicographically smallest path: a
    new node extends the smallest path among its parents of the last hop, where
    every path is final. Each hop is one written table of nodes and paths. The
    stop conditions (empty frontier, target reached) are observed metrics of the
    hop's own write.
    """
    base = scratch_path(spark, "bfs")
    adj.write.parquet(f"{base}/adj")
    adj = spark.read.parquet(f"{base}/adj")
    nodes = adj.select(F.col("src").alias("node")).distinct()
    first = start(nodes) if callable(start) else start.join(nodes, "node", "left_semi")
    hops = [_write_hop(first.select("node", F.array("node").alias("path")), f"{base}/hops/hop=0", target)]
    while hops[-1][1] and not hops[-1][2] and (max_hops is None or len(hops) <= max_hops):
        step = _next_hop(adj, [h[0] for h in hops[-2:]], F.min("path").alias("path"))
        step = step.withColumn("path", F.concat("path", F.array("node")))
        hops.append(_write_hop(step, f"{base}/hops/hop={len(hops)}", target))
    found = spark.read.schema("node string, path array<string>, hop int").parquet(f"{base}/hops")
    return found.select("node", F.col("hop").alias("hops"), "path")


def _next_hop(adj: DataFrame, last: list[DataFrame], kept: Column | None = None) -> DataFrame:
    """New nodes one hop beyond ``last[-1]``, each with ``kept`` of its parents (the smallest)."""
    step = (last[-1].withColumnRenamed("node", "src").join(adj, "src")
            .groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent") if kept is None else kept))
    for level in last:
        step = step.join(level.select("node"), "node", "left_anti")
    return step


def _write_hop(df: DataFrame, path: str, target: str | None) -> tuple[DataFrame, int, bool]:
    """Write one hop; its row count and whether it holds ``target`` are
    observed as metrics of the same job (no second pass over the hop)."""
    hit = F.max(F.when(F.col("node") == F.lit(target), 1).otherwise(0)) if target is not None else F.lit(0)
    obs = Observation()
    df.observe(obs, F.count(F.lit(1)).alias("rows"), hit.alias("hit")).write.parquet(path)
    m = obs.get
    return df.sparkSession.read.schema(df.schema).parquet(path), int(m["rows"]), bool(m["hit"])


def shortest_path(spark: SparkSession, edges: DataFrame, source: str, target: str,
                  weight: str | None = None) -> DataFrame:
    """The path from ``source`` to ``target`` as rows ``step, node`` (empty if none).

    Unweighted: both ends grow hop by hop, the smaller frontier first, until
    they meet; then the path is read along the hops in between, a few rows a
    hop. Of equally short paths it is the lexicographically smallest. With
    ``weight`` (a column of positive numbers): see ``weighted_path``.
    """
    adj = adjacency(edges)
    if weight:
        return weighted_path(spark, edges, source, target, weight)
    base = scratch_path(spark, "path")
    adj.write.parquet(f"{base}/adj")
    adj = spark.read.parquet(f"{base}/adj")
    nodes = adj.select(F.col("src").alias("node")).distinct()

    def end(name, at):
        first = nodes.where(F.col("node") == name).withColumn("parent", F.lit(None).cast("string"))
        return [_write_hop(first, f"{base}/{at}/hop=0", None)]

    ends = {"a": end(source, "a"), "b": end(target, "b")}
    empty = spark.createDataFrame([], "step int, node string")
    if not (ends["a"][0][1] and ends["b"][0][1]):
        return empty
    if source == target:
        return spark.createDataFrame([(0, source)], empty.schema)
    while True:
        side = min(ends, key=lambda e: ends[e][-1][1])
        hops = ends[side]
        hops.append(_write_hop(_next_hop(adj, [h[0] for h in hops[-2:]]), f"{base}/{side}/hop={len(hops)}", None))
        if not hops[-1][1]:
            return empty
        other = ends["b" if side == "a" else "a"][-1][0]
        if not hops[-1][0].join(other.select("node"), "node", "left_semi").isEmpty():
            break
    # levels of nodes on shortest paths, from the source: the last hops share
    # the middle; each level keeps the nodes next to the one after it
    near, far = [h[0].select("node") for h in ends["a"]], [h[0].select("node") for h in ends["b"]]
    levels = far[:-1] + [near[-1].join(far[-1], "node")]
    for level in reversed(near[:-1]):
        levels.append(_touching(adj, level, levels[-1]))
    levels.reverse()
    path, row = [], source
    for level in [None, *levels[1:]]:
        if level is not None:
            row = (level.join(adj.where(F.col("src") == row).select(F.col("dst").alias("node")), "node")
                   .agg(F.min("node")).first()[0])
        path.append((len(path), row))
    return spark.createDataFrame(path, empty.schema)


def _touching(adj: DataFrame, level: DataFrame, after: DataFrame) -> DataFrame:
    beside = adj.join(after.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
    return level.join(beside, "node", "left_semi")


def weighted_path(spark: SparkSession, edges: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """Least total ``weight``, as rows ``step, node, dist`` (empty if none).

    Nodes are settled in buckets of distance, near ones first. A bucket is as
    wide as the smallest weight, so no node of it can be improved through
    another: each is settled for good, its edges are relaxed once, and a round
    reads and writes only the nodes reached but not settled, beside the settled
    ones' names. Empty buckets are skipped. Of equally short ways the one through
    the smaller parent is kept. Weights must be positive.
    """
    schema = "step int, node string, dist double"
    e = edges.where(F.col("a") != F.col("b")).select("a", "b", F.col(weight).cast("double").alias("w"))
    base = scratch_path(spark, "weighted")
    (e.union(e.select("b", "a", "w")).toDF("src", "dst", "w").groupBy("src", "dst").agg(F.min("w").alias("w"))
     .write.parquet(f"{base}/adj"))
    adj = spark.read.parquet(f"{base}/adj")
    width = adj.agg(F.min("w")).first()[0]
    if width is not None and not width > 0:
        raise ValueError("weights must be positive")
    reached_schema = "node string, dist double, parent string"
    reached = (adj.where(F.col("src") == source).select(F.col("src").alias("node")).distinct()
               .select("node", F.lit(0.0).alias("dist"), F.lit(None).cast("string").alias("parent")))
    settled, r = None, 0
    while True:
        rows, near = _write_reached(reached, f"{base}/reached={r}")
        if not rows:
            return spark.createDataFrame([], schema)
        reached = spark.read.schema(reached_schema).parquet(f"{base}/reached={r}")
        bucket = F.col("dist") < near + width
        hit = _write_hop(reached.where(bucket), f"{base}/settled/round={r}", target)
        if hit[2]:
            break
        settled = spark.read.schema(reached_schema + ", round int").parquet(f"{base}/settled")
        step = (hit[0].withColumnRenamed("node", "src").join(adj, "src")
                .select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("parent")))
        step = step.join(settled.select("node"), "node", "left_anti")
        best = F.min(F.struct("dist", "parent")).alias("m")
        reached = (reached.where(~bucket).unionByName(step).groupBy("node").agg(best)
                   .select("node", "m.dist", "m.parent"))
        r += 1
    settled = spark.read.schema(reached_schema + ", round int").parquet(f"{base}/settled")
    nodes, node = [], target
    while node is not None:  # one look-up a step of the path
        row = settled.where(F.col("node") == node).select("dist", "parent").first()
        nodes.append((node, row["dist"]))
        node = row["parent"]
    return spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(reversed(nodes))], schema)


def _write_reached(df: DataFrame, path: str) -> tuple[int, float | None]:
    """Write the reached nodes; their number and least distance, observed."""
    obs = Observation()
    df.observe(obs, F.count(F.lit(1)).alias("rows"), F.min("dist").alias("near")).write.parquet(path)
    m = obs.get
    return int(m["rows"]), m["near"]
