"""Classifiers, PII and embeddings: brute force, held-out accuracy, awkward cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import awkward, nothing
from quire.llm import embedding_dedup, language_id, pii, quality

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


# --------------------------------------------------------------------- quality

def test_quality_keeps_clean_and_rejects_junk(spark):
    got = quality.op5_quality_classifier(spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.4 * len(junk)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_weights_are_log_ratios(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, None), (4, "")], "doc_id long, text string")
    ratio = quality.log_ratios(docs, spark.createDataFrame([(1,)], "doc_id long"), buckets=1 << 10)
    cells = {}
    for doc, text in ((1, "a b a"), (2, "c d")):
        cells[doc] = np.concatenate([c for c, _ in quality._cells([text], quality._Hashes(), 1 << 10)])
    raw = np.bincount(np.concatenate(list(cells.values())), minlength=1 << 10)
    target = np.bincount(cells[1], minlength=1 << 10)
    p = (raw + 1) / (raw.sum() + 1024)
    want = np.log((target + 1024 * p) / (target.sum() + 1024)) - np.log(p)
    assert np.allclose(ratio, want)
    got = {r["doc_id"]: r["log_weight"] for r in quality.weigh(docs, ratio).collect()}
    assert got[3] == got[4] == 0.0
    assert all(math.isclose(got[d], want[cells[d]].sum()) for d in (1, 2))


def test_kth_largest_is_exact(spark):
    rng = random.Random(8)
    for values in ([rng.gauss(0, 100) for _ in range(500)], [1.0] * 40 + [2.0] * 3, [5.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for k in {1, 2, len(values) // 2 or 1, max(1, len(values) - 1)}:
            want = sorted(values, reverse=True)[k - 1] if k < len(values) else -math.inf
            assert quality.kth_largest(df, k, bins=8) == want


def test_sample_is_gumbel_top_k(spark):
    docs = spark.createDataFrame([(i, "one two three four" if i % 2 else "five six") for i in range(300)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], LABELS)
    rows = quality.resample(docs, labels, keep_share=0.4).collect()
    kept = sorted((r["sample_key"] for r in rows if r["kept"]), reverse=True)
    assert kept == sorted((r["sample_key"] for r in rows), reverse=True)[:120]
    noise = [r["sample_key"] - r["log_weight"] for r in rows]
    assert abs(np.mean(noise) - 0.5772) < 0.25 and len(set(noise)) == 300


def test_share_follows_the_target(spark):
    """Toxic rows of quality 1 are no target, so they hold no place in the sample."""
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 1)) for i in range(2000)], LABELS)
    want = math.ceil((0.5 + 3 * math.sqrt(0.25 / 2000)) * 4000)
    assert quality.resample(docs, labels).where("kept").count() == want


def test_quality_awkward(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.resample(nothing(spark), none).count() == 0
    rows = quality.resample(awkward(spark), none).collect()
    assert len(rows) == 18 and all(r["kept"] and r["log_weight"] == 0 for r in rows)
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, None), (11, 1, 1), (None, 1, 0), (4, None, None)], LABELS)
    assert quality.resample(awkward(spark), labels).count() == 18


# ------------------------------------------------------------------ language id

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = language_id.op7_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_tables_equal_the_network():
    net = language_id.train([b"the cat and the dog " * 20, b"der hund und die katze " * 20], ["en", "de"])
    rows = np.concatenate([language_id.windows(t) for t in (b"the dog", b"der hund und", b"", b"x" * 600)])
    emb = net.p["embed"][rows]
    hidden = []
    for w in language_id.WIDTHS:
        view = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).swapaxes(2, 3)
        conv = view.reshape(len(rows), -1, w * language_id.EMBED) @ net.p[f"w{w}"] + net.p[f"b{w}"]
        hidden.append(np.maximum(conv.max(axis=1), 0))
    z = np.concatenate(hidden, axis=1) @ net.p["out"] + net.p["bias"]
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(language_id.log_probs(net.tables(), rows), want, atol=1e-3)


def test_gradients_match_differences():
    net = language_id.Network(["a", "b"], seed=1)
    net.p["embed"][0] = 0
    rng = np.random.default_rng(2)
    x = rng.integers(1, 257, (5, language_id.WINDOW))
    y, weight = np.array([0, 1, 1, 0, 1]), np.ones(5)

    def loss():
        t = net.tables()
        t = ([[a.astype(np.float64) for a in o] for o in t[0]], t[1], t[2])
        return -language_id.log_probs(t, x)[np.arange(5), y].mean()

    g = net.gradients(x, y, weight)
    for k in ("out", "bias"):
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        net.p[k][at] += 1e-3
        up = loss()
        net.p[k][at] -= 2e-3
        down = loss()
        net.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3


def test_language_awkward(spark):
    docs = awkward(spark)
    net = language_id.train([b"the cat and the dog " * 20, b"der hund und die katze " * 20], ["en", "de"])
    rows = language_id.predict(docs, net).collect()
    assert len(rows) == 18
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 5) or (r["doc_id"] is None and r["score"] == 0))
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(nothing(spark), net).count() == 0
    assert language_id.fit(nothing(spark).withColumn("lang", F.lit("en")), F.lit(True)) is None


# ------------------------------------------------------------------------- pii

def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_base(text):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        s = re.sub("[^0-9]", "", m[0])
        if 12 <= len(s) <= 19 and luhn(s):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


HARD = [
    "a@b.co@d.ef g@h", "..x@y.z..w@v.u", "a@b.com_x@c.de", "1.2.3.4.5.6.7.8", "1.2.3.4444 0001.2.3.4 256.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "411111111111111 1", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (974) 555-3436", "+1+2 345 678 901", "+12345678", "+1 2345678901234567", "é漢\U0001F600 ann@mail.org +44 20 7946 0958",
    "@" * 50 + "a" * 20_000, "1" * 20_000, "a.b" * 5000 + "@x.y", "+1" + "(" * 9000, "%+-@a-b.c-d", "x@y.1.2.3.4",
]


def test_base_spans(spark):
    rng = random.Random(9)
    texts = HARD + ["".join(rng.choice("a1.@+ -(2)9_") for _ in range(rng.randint(1, 120))) for _ in range(400)]
    texts += ["".join(rng.choice(["4111", " ", "-", "11111111", "1111", "+", ".", "25", "@a", "b.c"]) for _ in range(12))
              for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        got = [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["base"]]
        assert got == brute_base(texts[r["doc_id"]]), texts[r["doc_id"]][:80]
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}


def test_running_sums(spark):
    df = spark.createDataFrame([([],), ([3],), (list(range(2000)),)], "a array<long>")
    rows = df.select("a", F.expr(pii.running("a")).alias("s"),
                     F.expr(pii.running("a", "greatest({s}, {x})")).alias("m")).collect()
    for r in rows:
        assert r["s"] == np.cumsum(r["a"]).tolist() and r["m"] == np.maximum.accumulate(np.array(r["a"], int)).tolist()


def test_trees_add_what_the_checks_name(spark):
    """Keys look alike; those without a name before them are found by format."""
    rng = random.Random(10)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'some words token = "{hexa(40)}" and more') for i in range(400)]
    rows += [(400 + i, f"seen http/{'abc' * 8}/page today") for i in range(400)]
    rows += [(900, f'here "{hexa(40)}" stands alone')]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s["kind"] for s in got[900]["spans"]] == ["secret"] and not got[900]["base"]
    assert all(len(got[i]["spans"]) == 1 for i in range(400))
    assert not any(got[400 + i]["spans"] for i in range(400))


def test_rare_kinds_are_found(spark):
    """The same key is found alone as among many."""
    key = 'some words token = "0123456789abcdef0123456789abcdef01234567" and more'
    got = pii.find_pii(spark.createDataFrame([(1, key), (2, "plain words")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in got} == {1: ["secret"], 2: []}


def test_redact(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(99, None), (100, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got[99] is None and got[100] == ""
    assert got[13] == "é漢\U0001F600 [EMAIL] [PHONE]"
    assert got[9] == "[PHONE]" and got[14] == HARD[14]
    again = spark.createDataFrame(list(got.items()), "doc_id long, text string")
    assert not any(r["base"] for r in pii.find_pii(again).where("doc_id <> 0 and doc_id <> 3 and doc_id <> 19").collect())


def test_pii_awkward_and_contract(spark):
    rows = pii.find_pii(awkward(spark)).collect()
    assert len(rows) == 18
    assert [s["kind"] for r in rows if r["doc_id"] == 12 for s in r["base"]] == ["email", "phone", "ip", "card"]
    assert pii.find_pii(nothing(spark)).count() == 0 and pii.redact(nothing(spark)).count() == 0
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.op9_pii(spark, SF).collect():
        base = brute_base(docs[r["doc_id"]] or "")
        line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(b[1] == i for b in base) for i in range(4)]
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


# ------------------------------------------------------------------ embeddings

def brute_links(rows, least=0.98):
    """vec_id -> (links, component) by comparing every pair."""
    ok = [(i, np.array(v, float), g) for i, v, g in rows
          if g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent, n = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(ok)):
        for b in range(a):
            (i, v, g), (j, w, h) = ok[a], ok[b]
            if g == h and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= least:
                n[i] += 1
                n[j] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (n[i], find(i)) for i in n}


def test_embedding_clusters(spark):
    rng = np.random.default_rng(11)
    rows, i = [], 0
    for label, size in ((0, 1), (0, 2), (1, 60), (1, 7), (2, 25), (2, 1)):
        centre = rng.normal(size=24)
        for _ in range(size):
            rows.append((i, (centre + rng.normal(size=24) * 0.08).tolist(), label))
            i += 1
    for _ in range(150):
        rows.append((i, rng.normal(size=24).tolist(), int(rng.integers(0, 3))))
        i += 1
    rows += [(i + k, rows[k % 5][1], rows[k % 5][2]) for k in range(20)]  # copies
    i += 20
    nan = float("nan")
    rows += [(i, None, 1), (i + 1, [0.0] * 24, 1), (i + 2, [], 1), (i + 3, [nan] * 24, 1), (i + 4, rows[3][1], None),
             (i + 5, [1.0] * 23 + [float("inf")], 1), (i + 6, [1e200] * 24, 1), (i + 7, [2e200] * 24, 1),
             (i + 8, [None] + [1.0] * 23, 1), (i + 9, [1.0, 0.0], 1)]
    schema = "vec_id long, embedding array<double>, label int, kept string"
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    got = embedding_dedup.embedding_dedup(df).collect()
    want = brute_links([(a, None if v is None else [x / 1e200 if x and abs(x) > 1e100 else x for x in v], g) for a, v, g in rows])
    assert len(got) == len(rows) and got[0]["audit_recall"] >= 0.95
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_hub_compares_every_pair(spark):
    """A node with 100 listers, 60 of them new, and a list of its own: no pair is left out."""
    rng = np.random.default_rng(12)
    vecs = spark.createDataFrame([("g", i, rng.normal(size=4).tolist(), 1) for i in range(104)],
                                 "grp string, id long, vec array<double>, copies long")
    rows = [(i, 0, 0.5, int(i <= 60)) for i in range(1, 101)] + [(0, i, 0.5, int(i == 101)) for i in range(101, 104)]
    lists = spark.createDataFrame(rows, "u long, v long, sim double, fresh int")
    met = embedding_dedup._centres(vecs, lists, 10).mapInArrow(embedding_dedup._local(2.0), embedding_dedup._FOUND)
    got = {(r["u"], r["v"]) for r in met.where("not forest").collect()}
    new = {*range(1, 61), 101}
    assert got == {(u, v) for u in range(1, 104) for v in range(1, 104) if u != v and (u in new or v in new)}


def test_audit_sees_small_groups(spark):
    """A hot group found whole doesn't hide 20 pairs that were missed."""
    rng = np.random.default_rng(13)
    hot = rng.normal(size=16)
    rows = [("g", i, (hot + rng.normal(size=16) * 1e-3).tolist(), 50) for i in range(100)]
    for i in range(100, 140, 2):
        v = rng.normal(size=16)
        rows += [("g", i, v.tolist(), 1), ("g", i + 1, (v * 1.001 + 1e-4).tolist(), 1)]
    vecs = spark.createDataFrame(rows, "grp string, id long, vec array<double>, copies long")
    found = spark.createDataFrame([(i, 99 * 50, 99) for i in range(100)], "id long, n long, m long")
    whole = found.union(spark.createDataFrame([(i, 1, 1) for i in range(100, 140)], found.schema))
    assert embedding_dedup.audit(vecs, found, 0.98) < 0.5
    assert embedding_dedup.audit(vecs, whole, 0.98) == 1.0


def test_exact_when_the_search_falls_short(spark, monkeypatch):
    rng = np.random.default_rng(14)
    rows = []
    for i in range(0, 300, 2):
        v = rng.normal(size=16)
        rows += [(i, v.tolist(), i % 3), (i + 1, (v + rng.normal(size=16) * 0.02).tolist(), i % 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nothing_found = (spark.createDataFrame([], "u long, v long, sim double, fresh int, place int"),
                     spark.createDataFrame([], "u long, v long"))
    monkeypatch.setattr(embedding_dedup, "_search", lambda *a: nothing_found)
    got = embedding_dedup.embedding_dedup(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(rows)
    assert got[0]["audit_recall"] == 1.0


def test_rounds_follow_lists_with_room(spark):
    """New links of full lists don't count, new links beside them do."""
    full = [(1, v, 0.99, 0) for v in range(2, 5)]
    lists = spark.createDataFrame([*full, (9, 8, 0.99, 1), (9, 7, 0.5, 1)], "u long, v long, sim double, fresh int")
    assert embedding_dedup._open_links(lists, 0.98, 3) == (1, 1)


def test_large_component_in_spans(spark, monkeypatch):
    """Every pair of a component once, no join key with more than SPAN x SPAN pairs of blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "SPAN", 2)
    rng = np.random.default_rng(15)
    x = rng.normal(size=8) + rng.normal(size=(200, 8)) * 0.1
    members = spark.createDataFrame([(7, i, v.tolist(), 1 + i % 3, i % 2 == 0) for i, v in enumerate(x)],
                                    "root long, id long, vec array<double>, copies long, full boolean")
    met = embedding_dedup._compared(members, "root", 0.98)
    got = {r["id"]: (r["n"], r["m"]) for r in met.groupBy("id").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.98) & ~np.eye(200, dtype=bool)
    copies = 1 + np.arange(200) % 3
    assert got == {i: (int(hit[i] @ copies), int(hit[i].sum())) for i in range(0, 200, 2) if hit[i].any()}
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "ours" in plan and "theirs" in plan


def test_embedding_table_and_empty(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.op10_embedding_dedup(spark, SF).collect()}
    assert got == brute_links(rows)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_dedup(none).count() == 0
    one = spark.createDataFrame([(1, None, 1), (None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], none.schema)
    rows = embedding_dedup.embedding_dedup(one).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in rows) == \
        [("1", 0, "1"), ("None", 1, "None"), ("None", 1, "None")]
