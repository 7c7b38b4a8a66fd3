"""Dedup, packing, encoding and URL operators against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from llm_data import awkward, nothing
from quire.llm import bpe, exact_dedup, packing, simhash_dedup, substring_dedup, url_filter
from quire.llm.common import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def roots(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


# ------------------------------------------------------------------ components

@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(3)
    pairs = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 80)],
             "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "empty": []}[shape]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    want = roots(ids, [p for p in pairs if p[0] != p[1]])
    assert set(got) == ids
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a, b in itertools.combinations(ids, 2))


# ----------------------------------------------------------------- exact dedup

def test_exact_dedup_awkward(spark):
    rows = exact_dedup.exact_dedup(awkward(spark)).collect()
    assert len(rows) == 18
    by = {}
    for r in rows:
        by.setdefault(r["text"] or "", []).append(r)
    for text, group in by.items():
        ids = [r["doc_id"] for r in group]
        keep = max((i for i in ids if i is not None), default=None)
        for r in group:
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == \
                (keep, len(group), r["doc_id"] == keep, sha(text))


def test_exact_dedup_full_filter_stays_exact(spark):
    docs = documents(spark).select("doc_id", "text")
    want = {tuple(r) for r in exact_dedup.exact_dedup(docs).collect()}
    tiny = exact_dedup.exact_dedup(docs, max_filter_bytes=64)  # every row possibly repeated
    assert {tuple(r) for r in tiny.collect()} == want


def test_repeat_filter_finds_every_repeat(spark):
    h = spark.range(4000).select(F.xxhash64(F.col("id") % 3900).alias("h"))
    test = exact_dedup.repeat_filter(h)
    hit = h.withColumn("maybe", test(F.col("h"))).groupBy("h").agg(F.count("*").alias("n"), F.first("maybe").alias("maybe"))
    rows = hit.collect()
    assert all(r["maybe"] for r in rows if r["n"] > 1)
    assert sum(r["maybe"] for r in rows if r["n"] == 1) < 100


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(nothing(spark)).count() == 0


# -------------------------------------------------------------------- simhash

def brute_fingerprint(text, n=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("source", ["documents", "awkward"])
def test_simhash(spark, source):
    docs = documents(spark).select("doc_id", "text") if source == "documents" else awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fp = {t: brute_fingerprint(t) for _, t in rows}
    got = simhash_dedup.simhash_dedup(docs).collect()
    assert len(got) == len(rows)
    known = [(i, fp[t]) for i, t in rows]
    classes = sorted({f for _, f in known})
    root = roots(classes, [(a, b) for a, b in itertools.combinations(classes, 2) if (a ^ b).bit_count() <= 3])
    least = {}
    for i, f in known:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i is None, i or 0), f"{f:016x}", least.get(root[f])) for i, f in known)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"]) for r in got) == want


def test_simhash_links_every_near_pair(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for k in range(1, 6):
            f = b
            for bit in rng.sample(range(64), k):
                f ^= 1 << bit
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    got = {frozenset((r["u"], r["v"])) for r in edges.collect()}
    want = {frozenset((a, b)) for a, b in itertools.combinations(signed, 2)
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want


def test_simhash_empty(spark):
    assert simhash_dedup.simhash_dedup(nothing(spark)).count() == 0


# ------------------------------------------------------------- substring dedup

def brute_substring(rows, n=13):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k:k + n])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k:k + n])] < i:
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("source", ["documents", "awkward"])
def test_substring_dedup(spark, source):
    docs = documents(spark).select("doc_id", "text") if source == "documents" else awkward(spark)
    got = substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_substring([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_anchors_are_shared():
    """Every window holds an anchor, and equal windows hold the same ones."""
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**63, 40).astype(np.uint64)
    docs = [np.concatenate([rng.integers(0, 2**63, k).astype(np.uint64), shared]) for k in (3, 30)]
    block = substring_dedup._Block(docs)
    at, _ = block.anchors(13)
    one, two = (at[(at >= b) & (at < e)] - e for b, e in zip(block.begin, block.end))
    inside = lambda a: {int(x) for x in a if -40 + 12 <= x}
    assert inside(one) == inside(two) and inside(one)
    for s in range(0, 3 + 40 - 13):
        assert any(s <= x + block.end[0] <= s + 8 for x in one)


def test_substring_dedup_empty(spark):
    assert substring_dedup.substring_dedup(nothing(spark)).count() == 0


# --------------------------------------------------------------------- packing

def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), rng.randint(1, 8))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
        best = min(cost(c + (max(lengths),)) for r in range(min(k, len(lengths)))
                   for c in itertools.combinations(sorted(lengths)[:-1], r))
        bounds = packing.bucket_bounds(lengths, counts, k)
        assert cost(bounds) == best and len(bounds) <= k and bounds == sorted(set(bounds))


@pytest.mark.parametrize("source", ["documents", "awkward"])
def test_pack(spark, source):
    docs = documents(spark).select("doc_id", "text") if source == "documents" else awkward(spark)
    rows = packing.pack(docs, max_len=256, budget=1024, buckets=4).collect()
    want = sorted(str((r["doc_id"], s, min(256, max(n - s, 0)))) for r in docs.collect()
                  for n in [len(WORD.findall(r["text"] or ""))] for s in range(0, max(n, 1), 256))
    assert sorted(str((r["doc_id"], r["start"], r["n_tokens"])) for r in rows) == want
    bounds = packing.bucket_bounds(*zip(*((k, len(list(g))) for k, g in itertools.groupby(sorted(r["n_tokens"] for r in rows)))), 4)
    batches = {}
    for r in rows:
        assert r["bucket_len"] == bounds[r["bucket"]] == min(b for b in bounds if b >= r["n_tokens"])
        assert r["padding"] == r["bucket_len"] - r["n_tokens"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["position"])
    for b, bound in enumerate(bounds):
        own = sorted(k for k in batches if k[0] == b)
        per = 1024 // max(bound, 1)
        assert [k[1] for k in own] == list(range(len(own)))
        assert all(sorted(batches[k]) == list(range(per)) for k in own[:-1])
        assert sorted(batches[own[-1]]) == list(range(len(batches[own[-1]])))


def test_pack_empty(spark):
    assert packing.pack(nothing(spark)).count() == 0


# ------------------------------------------------------------------------- bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(open(PATH).read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_bpe_matches_library(own, theirs):
    rng = random.Random(4)
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|> <|endof", " 　x", "a" * 5000, "ab " * 500]
    for alphabet in ("ab", "the inreation", "aAé ñ'st\n 1", "=-_* ", "漢字\U0001F600 x"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    for t in texts:
        assert [i for b in own.encode(t) for i in b] == theirs.encode(t, add_special_tokens=False).ids


def test_bpe_pieces_agree_on_every_character(own, theirs):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}{c} b{c}1 {c}" for c in chars]
    got = [[i for b in own.encode(t) for i in b] for t in texts]
    assert got == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


def merged(own, data):
    """Every merge of the whole, lowest rank first, from the left."""
    ids = [own.single[b] for b in data]
    while len(ids) > 1:
        rank, at = min((own.ranks.get(p, (1 << 40,))[0], i) for i, p in enumerate(zip(ids, ids[1:])))
        if rank == 1 << 40:
            break
        ids[at: at + 2] = [own.ranks[ids[at], ids[at + 1]][1]]
    return ids


def test_transducer_emits_only_stable_tokens(own):
    """Whatever the chunks, and whatever follows what was emitted, nothing changes."""
    rng = random.Random(5)
    for _ in range(60):
        data = "".join(rng.choice("abehinrtx ") for _ in range(rng.randint(0, 700))).encode()
        step = rng.randint(1, 400)
        out = list(own.stream(data[i:i + step] for i in range(0, len(data), step)))
        assert [i for b in out for i in b] == merged(own, data)
    assert 0 < own.lookahead < 2000


def test_transducer_holds_constant_state(own, monkeypatch):
    seen = []
    chain = own.machine.chain
    monkeypatch.setattr(own.machine, "chain", lambda said, end: seen.append(len(said)) or chain(said, end))
    list(own._piece("ab" * 100_000))
    assert len(seen) > 40 and max(seen) <= bpe.BLOCK + own.lookahead + 256


def test_bpe_round_trip(spark, theirs):
    for docs in (documents(spark).select("doc_id", "text"), awkward(spark).select("doc_id", "text")):
        rows = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()}
        want = set()
        for r in docs.collect():
            ids = theirs.encode(r["text"] or "", add_special_tokens=False).ids
            want.add((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
        assert rows == want


def test_bpe_tokens_and_back(spark):
    docs = awkward(spark)
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted(str((r["doc_id"], r["text"] or "", r["kept"])) for r in docs.collect()) == \
        sorted(str((r["doc_id"], r["text"], r["kept"])) for r in back.collect())
    bad = spark.createDataFrame([(1, [232, 50256]), (2, None), (3, [])], "doc_id long, tokens array<int>")
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(bad, PATH, public_tokenizers.PATTERN).collect()}
    assert texts[1].endswith("<|endoftext|>") and texts[2] == texts[3] == ""
    assert bpe.round_trip(nothing(spark), PATH, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------------ urls

def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "a.org/x": ("", "", None, "allow"),
        "http://A.Example.ORG/es/1?q=/en/": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/17#top": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://example.org/en/27": ("example.org", "/en/27", "org/", "allow"),
        "https://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "https://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"),
        "https://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "https://x.com/de": ("x.com", "/de", None, "allow"),
        "https://x.com?/fr/": ("x.com", "", None, "allow"),
        "https://É.Com/fr/": ("É.com", "/fr/", "com/fr/", "allow"),
        "http:///fr/": ("", "/fr/", None, "allow"),
        "http://x.com:80/fr/": ("x.com:80", "/fr/", None, "allow"),
        "http://" + "a." * 5000 + "com/fr/" + "z/" * 5000: ("a." * 5000 + "com", "/fr/" + "z/" * 5000, "com/fr/", "allow"),
    }
    df = spark.createDataFrame([(u, "old") for u in cases], "url string, rule string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got == cases
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_trie_against_all_rules():
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "org"]
    paths = ["", "x", "x/", "x/y", "xy/", "x/y/z"]
    for _ in range(200):
        rules = [(rng.choice(["allow", "block"]), f"{rng.choice(hosts)}/{rng.choice(paths)}") for _ in range(rng.randint(0, 8))]
        trie = url_filter.compile_rules(rules)
        host, path = rng.choice(hosts + ["c.b.a.com", "net"]), "/" + rng.choice(paths + ["xx", "x/yy/z"])
        fit = [(len(r), len(r.partition("/")[0]), r) for _, r in rules
               if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0]))
               and path.startswith("/" + r.partition("/")[2])]
        rule, verdict = url_filter.judge(trie, host, path)
        assert rule == (max(fit)[2] if fit else None)
        if rule:
            assert verdict == ("block" if ("block", rule) in rules else "allow")
    with pytest.raises(ValueError):
        url_filter.compile_rules([("deny", "a/")])
