"""Embedding near-dedup: NN-descent.

Equal vectors of a label become one class with a count. Neighbour lists start
from random projections (vectors sorted by sign code, compared with the next
few), then rounds of neighbours-of-neighbours joins refine them: the members of
a node's list, and those that list the node, are compared with each other, and
whoever beats the worst entry of a list enters it. A node with very many
listers is dealt in blocks, every pair of which is compared. Rounds end when
the lists that have room left hardly find new links.

A list full of links is saturated: it is enlarged to the whole component of
its node, compared block by block, so no link is lost to the length of a list.
Every pair found at the threshold feeds the components, as a spanning forest of
each comparison. An audit compares a bounded uniform set of vectors with all;
if recall falls short the search is repeated with longer lists, and after the
longest every pair of a group is compared, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import _roots, components, fresh, table, written

MIN_COSINE = 0.98
LIST = 10
TABLES = 8
NEXT = 6
CODE_BITS = 16
LISTERS = 24
BLOCK = 128
SPAN = 16
ROUNDS = 8
STILL = 0.002
AUDIT = 1024
MIN_RECALL = 0.95
SEED = 10


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    """The vectors of a list column in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.asarray(column.value_lengths())
    return np.split(values, np.cumsum(size)[:-1]) if len(size) else []


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(bits: int):
    """(grp, id, vec) -> a row per table with its sign code and projection."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            vec = _rows(b.column(2))
            size = np.array([len(v) for v in vec])
            for dim in np.unique(size):
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED + int(dim)).normal(size=(dim, TABLES * (bits + 1)))
                rows = np.flatnonzero(size == dim)
                x = _unit([vec[i] for i in rows]) @ planes[dim]
                part = b.take(pa.array(rows))
                for t in range(TABLES):
                    y = x[:, t * (bits + 1): (t + 1) * (bits + 1)]
                    code = (y[:, :-1] > 0) @ (1 << np.arange(bits)[::-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t)), pa.array(code.astype(np.int64)), pa.array(y[:, -1]), *part.columns],
                        ["t", "code", "proj", "grp", "id", "vec"])
    return run


_FOUND = "u long, v long, sim double, forest boolean"


def _found(u, v, sim, forest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64)), pa.array(np.asarray(sim, np.float64)),
         pa.array(np.full(len(u), forest))], ["u", "v", "sim", "forest"])


def _star(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    nodes, root = _roots(u, v)
    on = nodes != root
    return _found(nodes[on], root[on], np.ones(on.sum()), True)


def _adjacent(min_cosine: float):
    """Rows sorted by (t, grp, code, proj): each with its best of the next and previous few."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[tuple] = []
        for b in batches:
            rows = tail + list(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(),
                                   _rows(b.column(5))))
            lo = 0
            while lo < len(rows):  # runs of one table and group
                hi = lo
                while hi < len(rows) and rows[hi][:2] == rows[lo][:2]:
                    hi += 1
                ids = np.array([r[2] for r in rows[lo:hi]], np.int64)
                x = _unit([r[3] for r in rows[lo:hi]])
                us, vs, ss = [], [], []
                for j in range(1, min(NEXT, len(x) - 1) + 1):
                    s = (x[:-j] * x[j:]).sum(axis=1)
                    us += [ids[:-j], ids[j:]]
                    vs += [ids[j:], ids[:-j]]
                    ss += [s, s]
                if us:
                    u, v, s = map(np.concatenate, (us, vs, ss))
                    link = s >= min_cosine
                    if link.any():
                        yield _star(u[link], v[link])
                    order = np.lexsort((-s, u))
                    u, v, s = u[order], v[order], s[order]
                    start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                    place = np.arange(len(u)) - np.repeat(start, np.diff(np.r_[start, len(u)]))
                    best = place < 4
                    yield _found(u[best], v[best], s[best], False)
                lo = hi
            tail = rows[-NEXT:]
    return run


def _local(min_cosine: float):
    """One row per centre: compare its members where one of a pair is new."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            out: list[list[np.ndarray]] = [[], [], []]
            stars: list[list[np.ndarray]] = [[], []]
            bounds = lists.offsets.to_numpy()
            flat = lists.values
            ids = flat.field("id").to_numpy(zero_copy_only=False)
            new = flat.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
            worst = flat.field("worst").to_numpy(zero_copy_only=False)
            vec = _rows(flat.field("vec"))
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                own, at = np.unique(ids[lo:hi], return_index=True)
                if len(own) < 2 or not new[lo:hi].any():
                    continue
                x = _unit([vec[lo + i] for i in at])
                fresh_, limit = np.maximum.reduceat(new[lo:hi][np.argsort(ids[lo:hi], kind="stable")],
                                                    np.searchsorted(np.sort(ids[lo:hi]), own)), worst[lo:hi][at]
                s = x @ x.T
                pair = (fresh_[:, None] | fresh_[None, :]) & ~np.eye(len(own), dtype=bool)
                i, j = np.nonzero(pair & (s > limit[:, None]))
                for to, a in zip(out, (own[i], own[j], s[i, j])):
                    to.append(a)
                i, j = np.nonzero(np.triu(pair & (s >= min_cosine)))
                if len(i):
                    stars[0].append(own[i])
                    stars[1].append(own[j])
            if out[0]:
                yield _found(*map(np.concatenate, out), False)
            if stars[0]:
                yield _star(*map(np.concatenate, stars))
    return run


_COMPARED = "id long, n long, m long, v long"


def _blocks_run(min_cosine: float, edges: bool):
    """One row per pair of blocks (queries, members): links of each query by members'
    counts (``n``) and by members (``m``); with ``edges`` also star edges ``(id, v)`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                q, m = b.column(0)[k].values, b.column(1)[k].values
                qi, mi = (a.field("id").to_numpy(zero_copy_only=False) for a in (q, m))
                s = _unit(_rows(q.field("vec"))) @ _unit(_rows(m.field("vec"))).T
                hit = (s >= min_cosine) & (qi[:, None] != mi[None, :])
                any_ = np.flatnonzero(hit.any(axis=1))
                if not len(any_):
                    continue
                n = hit[any_] @ m.field("copies").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qi[any_]), pa.array(n), pa.array(hit[any_].sum(axis=1)), pa.nulls(len(any_), pa.int64())],
                    ["id", "n", "m", "v"])
                if edges:
                    i, j = np.nonzero(hit)
                    nodes, root = _roots(qi[i], mi[j])
                    none = pa.nulls(len(nodes), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), none, none, pa.array(root)], ["id", "n", "m", "v"])
    return run


def _compared(members: DataFrame, key: str, min_cosine: float, edges: bool = False) -> DataFrame:
    """``_COMPARED`` rows of every member that is ``full`` against all of the same ``key``, in blocks.

    The joined rows are keyed by ``key``, a span of ``SPAN`` blocks of queries
    and one of members, so no task holds a whole ``key``; its pairs of blocks
    still grow with the square of its size.
    """
    blocks = (members.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
                                       F.max("full").alias("any")).where("any").drop("any"))
    dealt = written(members.join(blocks, key)
                    .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "members")
    item = F.struct("id", "copies", "vec")
    span = F.floor(F.col("block") / SPAN)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / SPAN)))
    wanted = (dealt.where("full").groupBy(key, "blocks", "block").agg(F.collect_list(item).alias("queries"))
              .select(key, span.alias("ours"), every.alias("theirs"), "queries"))
    whole = (dealt.groupBy(key, "blocks", "block").agg(F.collect_list(item).alias("others"))
             .select(key, every.alias("ours"), span.alias("theirs"), "others"))
    both = wanted.join(whole, [key, "ours", "theirs"]).select("queries", "others")
    return both.mapInArrow(_blocks_run(min_cosine, edges), _COMPARED)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest ``v`` of each ``u``; ``fresh`` is 0 for a pair listed before."""
    once = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("place", place).where(F.col("place") <= k)


def _centres(vecs: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """``members`` to compare: what each node lists and the nodes that list it.

    More than ``LISTERS`` listers are dealt into blocks, the fresh ones apart,
    with a row for every pair of blocks of which one is fresh, and a row of
    each block with the node's own list: together the pairs of one row.
    """
    worst = (lists.groupBy("u").agg(F.count("*").alias("held"), F.min("sim").alias("least"))
             .select(F.col("u").alias("id"), F.when(F.col("held") < k, -2.0).otherwise(F.col("least")).alias("worst")))
    new, known = F.sum("fresh"), F.sum(1 - F.col("fresh"))
    few = F.count("*") <= LISTERS
    listers = (lists.groupBy(F.col("v").alias("centre"))
               .agg(F.when(few, 1).otherwise(F.ceil(new / LISTERS)).cast("int").alias("new"),
                    F.when(few, 0).otherwise(F.ceil(known / LISTERS)).cast("int").alias("known")))
    dealt = lists.select(F.col("v").alias("centre"), F.col("u").alias("id"), "fresh").join(listers, "centre")
    hashed = F.xxhash64("id")
    own = (F.when(F.col("new") + F.col("known") == 1, 0)
           .when(F.col("fresh") == 1, F.pmod(hashed, F.col("new")))
           .otherwise(F.col("new") + F.pmod(hashed, F.col("known")))).cast("int")
    last = F.col("new") + F.col("known") - 1
    before_new = F.expr("if(new = 0, array(), sequence(0, new - 1))")
    met = (F.when(F.col("own") < F.col("new"), F.sequence(F.lit(0), last))
           .otherwise(F.concat(before_new, F.array("own"))))
    back = dealt.withColumn("own", own).select("centre", "id", "fresh", "own", met.alias("others"))
    alone = F.when(F.col("new").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last))
    ahead = (lists.select(F.col("u").alias("centre"), F.col("v").alias("id"), "fresh")
             .join(listers, "centre", "left")
             .select("centre", "id", "fresh", F.lit(None).cast("int").alias("own"), alone.alias("others")))
    member = F.struct("id", "fresh", "worst", "vec")
    return (back.unionByName(ahead)
            .join(vecs.select("id", "vec").join(worst, "id", "left").fillna(-2.0, "worst"), "id")
            .withColumn("other", F.explode("others")).withColumn("own", F.coalesce("own", "other"))
            .groupBy("centre", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
            .agg(F.collect_list(member).alias("members")).select("members"))


def _open_links(lists: DataFrame, min_cosine: float, k: int) -> tuple[int, int]:
    """New and all links of lists that have room for more."""
    near = lists.where(F.col("sim") >= min_cosine).groupBy("u").agg(F.sum("fresh").alias("new"), F.count("*").alias("n"))
    got = near.where(F.col("n") < k).agg(F.sum("new"), F.sum("n")).first()
    return got[0] or 0, got[1] or 0


def _search(vecs: DataFrame, min_cosine: float, k: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Final lists ``(u, v, sim, fresh, place)`` and forest edges ``(u, v)`` of all links met."""
    spark = vecs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(62, max(CODE_BITS, vecs.count().bit_length()))
    coded = (vecs.select("grp", "id", "vec")
             .mapInArrow(_codes(bits), f"t long, code long, proj double, grp string, id long, vec {dict(vecs.dtypes)['vec']}")
             .repartitionByRange(n, "t", "grp", "code", "proj").sortWithinPartitions("t", "grp", "code", "proj"))
    met = written(coded.mapInArrow(_adjacent(min_cosine), _FOUND), "adjacent")
    forest = met.where("forest").select("u", "v")
    lists = written(_top(met.where("not forest").select("u", "v", "sim", F.lit(1).alias("fresh")), k), "lists")
    for r in range(rounds):
        centres = _centres(vecs, lists, k)
        met = written(centres.mapInArrow(_local(min_cosine), _FOUND), "met")
        forest = forest.union(met.where("forest").select("u", "v"))
        old = lists.select("u", "v", "sim", F.lit(0).alias("fresh"))
        lists = written(_top(old.union(met.where("not forest").select("u", "v", "sim", F.lit(1))), k), "lists")
        new, links = _open_links(lists, min_cosine, k)
        if r and new <= STILL * links:
            break
    return lists, forest


def _links(vecs: DataFrame, lists: DataFrame, comp: DataFrame, min_cosine: float, k: int) -> DataFrame:
    """``(id, n, m)``: copies of other classes, and other classes, linked to each class.

    A list with room left has all its node's links, its own or the other
    side's. Saturated lists are enlarged to the component, in blocks.
    """
    near = lists.where(F.col("sim") >= min_cosine)
    full = near.groupBy("u").count().where(F.col("count") >= k).select(F.col("u").alias("id"))
    pairs = near.select("u", "v").union(near.select("v", "u")).distinct()
    counts = vecs.select(F.col("id").alias("v"), "copies")
    listed = (pairs.join(counts, "v").groupBy(F.col("u").alias("id"))
              .agg(F.sum("copies").alias("n"), F.count("*").alias("m")))
    listed = listed.join(full, "id", "left_anti")

    members = (comp.join(vecs, "id").join(full.withColumn("full", F.lit(True)), "id", "left")
               .fillna(False, "full"))
    grown = _compared(members, "root", min_cosine).groupBy("id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return written(listed.unionByName(grown), "links")


def _exact(vecs: DataFrame, min_cosine: float) -> tuple[DataFrame, DataFrame]:
    """Links and forest edges of every pair of a group, compared block by block."""
    met = written(_compared(vecs.withColumn("full", F.lit(True)), "grp", min_cosine, True), "exact")
    links = met.where("v is null").groupBy("id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return written(links, "links"), met.where("v is not null").select(F.col("id").alias("u"), "v")


def audit(vecs: DataFrame, links: DataFrame, min_cosine: float, most: int = AUDIT) -> float:
    """Share of the classes linked to a class that were found, against all rows: the
    mean over a uniform set of ``most`` classes, every class that has links counting the
    same. Of classes with fewer than ``LIST`` links and of the others the lower
    mean holds; 1 where there are no links."""
    asked = vecs.orderBy(F.xxhash64("id", F.lit(SEED))).limit(most).select("grp", "id", "vec").collect()  # bounded
    if not asked:
        return 1.0
    by: dict[str, tuple] = {}
    for g in {r["grp"] for r in asked}:
        own = [r for r in asked if r["grp"] == g]
        by[g] = (np.array([r["id"] for r in own]), _unit([np.asarray(r["vec"], np.float64) for r in own]))
    shared = vecs.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            grp = np.array(b.column(0).to_pylist(), object)
            ids = b.column(1).to_numpy(zero_copy_only=False)
            vec = _rows(b.column(2))
            for g, (qi, q) in shared.value.items():
                rows = np.flatnonzero(grp == g)
                if len(rows):
                    hit = (q @ _unit([vec[i] for i in rows]).T >= min_cosine) & (qi[:, None] != ids[rows][None, :])
                    for i, c in zip(qi, hit.sum(axis=1)):
                        total[int(i)] = total.get(int(i), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         ["id", "true"])

    true = (vecs.select("grp", "id", "vec").mapInArrow(run, "id long, true long")
            .groupBy("id").agg(F.sum("true").alias("true")).where(F.col("true") > 0))
    found = F.least(F.lit(1.0), F.coalesce("m", F.lit(0)) / F.col("true"))
    means = (true.join(links, "id", "left").groupBy(F.col("true") < LIST).agg(F.avg(found).alias("mean")).collect())
    return min([1.0, *(r["mean"] for r in means)])


def embedding_dedup(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    min_cosine: float = MIN_COSINE, k: int = LIST, rounds: int = ROUNDS,
                    min_recall: float = MIN_RECALL) -> DataFrame:
    """``rows`` without its vector, plus ``n_links`` (other vectors linked),
    ``component_id`` (smallest vec_id reachable, itself included), ``kept``
    (the two ids are equal) and ``audit_recall``.

    Vectors link at a cosine of ``min_cosine`` or more in double precision,
    only if their labels are equal and not null and they have the same length.
    A null, empty or zero vector, or one with a null or non-finite component,
    links with nothing. Equal vectors are linked copies. A row with a null
    vec_id takes part in links but names no component. Repeated rows are
    copies. Extra columns are carried, clashing ones replaced; an empty table
    gives an empty table.
    """
    new = ["n_links", "component_id", "kept", "audit_recall"]
    rows = rows.drop(*new)
    spark = rows.sparkSession
    vec = F.col(vector)
    sound = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    usable = F.coalesce(F.col(label).isNotNull() & sound, F.lit(False))
    grp = F.concat_ws(":", F.col(label).cast("string"), F.size(vec).cast("string"))
    classes = written(rows.where(usable).groupBy(grp.alias("grp"), vec.alias("vec"))
                      .agg(F.min(vec_id).alias("rep"), F.count("*").alias("copies")), "classes")
    named = written(classes.withColumn("id", F.xxhash64("grp", "vec")), "vectors")
    if named.groupBy("id").count().where("count > 1").isEmpty():
        vecs = named
    else:
        raise RuntimeError("two vectors with one 64-bit hash")
    while True:
        lists, forest = _search(vecs, min_cosine, k, rounds)
        comp = written(components(forest).withColumnRenamed("u", "id"), "roots")
        links = _links(vecs, lists, comp, min_cosine, k)
        recall = audit(vecs, links, min_cosine)
        if recall >= min_recall:
            break
        if k >= 16 * LIST:
            links, forest = _exact(vecs, min_cosine)
            comp = written(components(forest).withColumnRenamed("u", "id"), "roots")
            recall = audit(vecs, links, min_cosine)
            break
        k *= 2
    least = comp.join(vecs, "id").groupBy("root").agg(F.min("rep").alias("least"))
    final = (vecs.select("id", "rep", "copies").join(comp, "id", "left").join(least, "root", "left")
             .join(links, "id", "left")
             .select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("least", "rep").alias("component_id")))
    final = written(final, "final")
    (key,) = fresh(rows, "key")
    out = rows.withColumn(key, F.when(usable, F.xxhash64(grp, vec))).drop(vector)
    return (out.join(final.withColumnRenamed("id", key), key, "left")
            .withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
            .withColumn("component_id", F.when(F.col(key).isNull(), F.col(vec_id)).otherwise(F.col("component_id")))
            .withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))
            .withColumn("audit_recall", F.lit(float(recall))).drop(key))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embedding_dedup(rows).drop("label")
