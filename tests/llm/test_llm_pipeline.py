"""The pipeline stage by stage against brute force, and the registered SQL."""

import pytest

import __spark_entry__ as E
import corpus_pipeline
from llm_data import awkward, nothing
from oracle_check import compare, duck_connection
from test_llm_models import brute_base
from test_llm_text_ops import brute_fingerprint, roots

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["op3_exact_dedup", "op6_url_filter"])
def test_sql(spark, key):
    ok, _ = compare(spark, SF, key, duck_connection(SF), verbose=False)
    assert ok


def test_registered():
    names = {f"op{n}_" for n in range(1, 11)}
    assert names == {k.split("_")[0] + "_" for k in E.queries() if k.startswith("op")}
    assert "pipeline" in E.queries()
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "pii", "packing"]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, SF)
    assert kept.columns == cols and 0 < kept.count() < docs.count()

    rows = docs.collect()
    once = stages["exact dedup"](spark, docs, SF)
    assert once.columns == cols
    last = {}
    for r in rows:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(last.values())

    near = stages["near dedup"](spark, docs, SF)
    assert near.columns == cols
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    ids = sorted(fp)
    root = roots(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(root.values()))

    clean = stages["pii"](spark, docs, SF)
    assert clean.columns == cols
    was = {r["doc_id"]: r["text"] for r in rows}
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"])
        assert (r["text"] == was[r["doc_id"]]) or "[" in r["text"]
        if brute_base(was[r["doc_id"]]):
            assert r["text"] != was[r["doc_id"]] and not brute_base(r["text"])


def test_packed_segments_hold_the_text(spark):
    """Segments in order are the text again, also of long, blank and null ones."""
    docs = awkward(spark).where("doc_id <> 2").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(90, " \t lead\n two  three ")], docs.schema))
    parts = {}
    for r in sorted(dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF).collect(), key=lambda r: r["segment"]):
        parts.setdefault(r["doc_id"], []).append(r["text"])
        assert len((r["text"] or "").encode().split()) == r["n_tokens"]
    assert len(parts[11]) > 1
    for r in docs.where("doc_id is not null").collect():
        assert parts[r["doc_id"]] == [None] if r["text"] is None else "".join(parts[r["doc_id"]]) == r["text"]


def test_near_decides_on_rows(spark):
    """An id on two texts loses only the copy; null ids and equal rows leave one row."""
    near = dict(corpus_pipeline.STAGES)["near dedup"]
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in ("apple", "brick", "cloud"))
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c), (7, "seven " + b[::-1]), (7, "seven " + b[::-1]), (None, a)]
    got = near(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=i, text=t)) for i, t in [rows[0], rows[2], rows[3], rows[5]])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and {"doc_id", "bucket", "batch", "position"} <= set(out.columns)
    assert len({(r["bucket"], r["batch"], r["position"]) for r in rows}) == len(rows)


def test_stages_on_awkward_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        for docs, n in ((awkward(spark), 18), (nothing(spark), 0)):
            out = stage(spark, docs, SF)
            assert out.count() <= n or name == "packing"
            if name != "packing":
                assert out.columns == docs.columns
