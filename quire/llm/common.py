"""Helpers shared by the operators: tables, written intermediates, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import scratch_path

#: Word separators of every text contract: space and the ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back (cuts lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names not yet in ``df`` (compared case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


_ARROW = {T.LongType: pa.int64(), T.StringType: pa.string(), T.ArrayType: pa.list_(pa.int32())}


def over_text(docs: DataFrame, text: str, coder, fields: list[T.StructField], rows) -> DataFrame:
    """``docs`` without ``text`` plus ``fields``: the tuple ``rows(coder.get(), value)`` of each row."""
    taken = {text.lower(), *(f.name.lower() for f in fields)}
    rest = [c for c in docs.columns if c.lower() not in taken]
    src = docs.select(*(docs[c] for c in rest), docs[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = coder.get()
        for b in batches:
            got = [rows(built, v.as_py() or "") for v in b.column(len(rest))]
            new = zip(*got) if got else [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *(pa.array(c, _ARROW[type(f.dataType)]) for c, f in zip(new, fields))],
                names=[*rest, *(f.name for f in fields)])

    return src.mapInArrow(run, T.StructType([*(docs.schema[c] for c in rest), *fields]))


def words(data: bytes) -> list[bytes]:
    """The words of UTF-8 text; ``bytes.split`` cuts at exactly 20 and 09-0D."""
    return data.split()


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex of each one's component (min-label hooking)."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u):]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == lab).all():
            return nodes, nodes[lab]
        lab = new


def _forest(batches: Iterator[pa.RecordBatch], block: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Star edges of the components of each block of edges: same connectivity, fewer edges."""
    us, vs, n = [], [], 0

    def flush():
        nodes, root = _roots(np.concatenate(us), np.concatenate(vs))
        keep = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], ["u", "v"])

    for b in batches:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
        n += b.num_rows
        if n >= block:
            yield flush()
            us, vs, n = [], [], 0
    if n:
        yield flush()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, root)`` for every vertex of the edge list ``(u, v)`` of longs.

    ``root`` names the component (any one vertex of it). Rounds of random
    contraction: every vertex points to the neighbour with the least hash of
    the round, pointers are followed once, and the edges are rewritten between
    the vertices pointed at; each round shrinks the graph by a constant factor
    in expectation, whatever its shape. A star vertex is reduced by a partial
    minimum, its edges by blocks of each task. Every round is a written table.
    """
    spark = edges.sparkSession
    e = (edges.toDF("u", "v").where("u <> v").mapInArrow(_forest, "u long, v long"))
    e = written(e.distinct(), "edges")
    maps: list[DataFrame] = []
    for r in range(max_rounds):
        if e.isEmpty():
            break
        both = e.union(e.select("v", "u"))
        rank = F.xxhash64(F.col("v"), F.lit(r))
        near = both.groupBy("u").agg(F.min(F.struct(rank.alias("h"), F.col("v"))).alias("m"))
        own = F.xxhash64(F.col("u"), F.lit(r))
        f = near.select("u", F.when(F.col("m.h") < own, F.col("m.v")).otherwise(F.col("u")).alias("p"))
        f = written(f, "pointers")
        g = f.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        f = written(f.join(g, "p").select("u", F.col("pp").alias("p")), "pointers2")
        maps.append(f)
        fu = f.select("u", F.col("p").alias("pu"))
        fv = f.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        nxt = (e.join(fu, "u").join(fv, "v").where("pu <> pv")
               .select(F.col("pu").alias("u"), F.col("pv").alias("v"))
               .mapInArrow(_forest, "u long, v long").distinct())
        e = written(nxt, "edges")
    else:
        raise RuntimeError("components did not converge")
    if not maps:
        return spark.createDataFrame([], "u long, root long")
    out = maps[0].select("u", F.col("p").alias("root"))
    for f in maps[1:]:
        step = f.select(F.col("u").alias("root"), F.col("p").alias("next"))
        out = out.join(step, "root", "left").select("u", F.coalesce("next", "root").alias("root"))
    return out
