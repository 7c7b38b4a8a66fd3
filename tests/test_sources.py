"""Catalogue JSON, whole-text files, log, export, streaming ingest."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from quire.sources import files as FS
from quire.sources import metadata as MD
from quire.sources.sinks import export_csv
from quire.streaming import querylog as QL
from quire.streaming.ingest import ingest_books


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_and_flatten_catalogue(spark, tmp_dir):
    recs = [
        {"Num": "1", "Author": ["?"], "Author Birth": ["1800"], "Title": [], "Language": "English",
         "gd-num-padded": "00001", "gd-path": "000/00001.txt", "charset": "?"},
        {"Num": "x2", "Author": ["Ann"], "Title": ["x?"], "Language": ["French"]},
    ]
    p = os.path.join(tmp_dir, "meta.json")
    write(p, json.dumps(recs))
    rows = MD.flatten_metadata(MD.read_metadata(spark, p)).orderBy(F.col("num").asc_nulls_last()).collect()
    a, b = rows
    assert (a.num, a.author, a.author_birth, a.title, a.language) == (1, None, "1800", None, None)
    assert (a.gd_num_padded, a.gd_path, a.charset) == ("00001", "000/00001.txt", None)
    assert (b.num, b.author, b.title, b.language) == (None, "Ann", "x?", "French")
    rejects = MD.metadata_rejects(MD.read_metadata(spark, p)).collect()
    assert [r.raw_num for r in rejects] == ["x2"]


def test_read_contents_keeps_empty_and_trims_one_newline(spark, tmp_dir):
    root = os.path.join(tmp_dir, "books")
    write(os.path.join(root, "000/00001.txt"), "Hello.\nWorld.\n\n")
    write(os.path.join(root, "000/00002.txt"), "")
    meta = spark.createDataFrame([(1, "000/00001.txt"), (2, "000/00002.txt"), (3, "000/00003.txt")],
                                 "num long, gd_path string")
    got = {r.num: r.content for r in FS.read_contents(spark, meta, root).collect()}
    assert got == {1: "Hello.\nWorld.\n", 2: "", 3: ""}


def test_contents_with_odd_paths_and_report(spark, tmp_dir):
    root = os.path.join(tmp_dir, "my books+x%20")
    write(os.path.join(root, "a b/c+d.txt"), "one\n")
    write(os.path.join(root, "a b/e%41.txt"), "two")
    write(os.path.join(root, "z.txt"), "")
    write(os.path.join(root, "un listed.txt"), "u")
    meta = spark.createDataFrame([(1, "a b/c+d.txt"), (2, "a b/e%41.txt"), (3, "z.txt"), (4, "no.txt")],
                                 "num long, gd_path string")
    for r in (root, "file:" + root):
        assert {x.num: x.content for x in FS.read_contents(spark, meta, r).collect()} == {1: "one", 2: "two", 3: "", 4: ""}
        assert {(x.num, x.rel_path): x.status for x in FS.content_report(spark, meta, r).collect()} == {
            (3, "z.txt"): "empty", (4, "no.txt"): "missing", (None, "un listed.txt"): "unlisted"}


def test_read_metadata_many_records(spark, tmp_dir):
    p = os.path.join(tmp_dir, "meta.json")
    write(p, json.dumps([{"Num": i, "Title": [f"t{i}", "x"], "Author Birth": ["?" if i % 2 else str(1800 + i)]}
                         for i in range(300)]))
    rows = MD.flatten_metadata(MD.read_metadata(spark, p)).collect()
    assert sorted((r.num, r.title, r.author_birth) for r in rows if r.num < 3) == [
        (0, "t0", "1800"), (1, "t1", None), (2, "t2", "1802")] and len(rows) == 300


def test_scale_settings_at_100_tib():
    from quire.session import scale_settings
    s = scale_settings(100 * 2**40, 8000)
    maps = 100 * 2**40 / int(s["spark.sql.files.maxPartitionBytes"])
    parts = int(s["spark.sql.shuffle.partitions"])
    assert maps <= 200_001 and 16_000 <= parts <= 50_000
    assert int(scale_settings(2**30, 8)["spark.sql.shuffle.partitions"]) == 16


def test_path_part(spark):
    df = spark.createDataFrame([("000/00001.txt",), (None,), ("x",)], "p string")
    got = [r.d for r in df.select(FS.path_part(F.col("p"), 1).alias("d")).collect()]
    assert got == ["000", None, "x"]


def test_query_log_append(spark, tmp_dir):
    p = os.path.join(tmp_dir, "log")
    t = dt.datetime(2026, 1, 1, 12, 0, 0)
    QL.log_search(spark, p, "english", "cat to dog", 10, 1, now=t)
    QL.log_discovery(spark, p, "english", "cat dog", now=t)
    QL.log_search(spark, p, "english", "cat to dog", 10, 11)
    log = QL.read_log(spark, p)
    rows = sorted((r.tab, r.rows_returned_aka_limit, r.start_row_aka_offset) for r in log.collect())
    assert rows == [("Discovery", 30, 0), ("Search", 10, 1), ("Search", 10, 11)]
    stats = {(r.tab, r.query): r.searches for r in QL.log_stats(log).collect()}
    assert stats == {("Search", "cat to dog"): 2, ("Discovery", "cat dog"): 1}


def test_export_csv(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a,b")], "num long, t string")
    out = export_csv(df, os.path.join(tmp_dir, "csv"))
    back = spark.read.option("header", True).csv(out).collect()
    assert [(r.num, r.t) for r in back] == [("1", "a,b")]


def test_streaming_ingest(spark, tmp_dir):
    root = os.path.join(tmp_dir, "in")
    write(os.path.join(root, "000/00001.txt"), "One.\nTwo.\n")
    write(os.path.join(root, "000/00002.txt"), "Drei.\nVier")
    write(os.path.join(root, "000/99 999.txt"), "nobody's")
    meta = spark.createDataFrame([(1, "English", "000/00001.txt"), (2, "German", "000/00002.txt")],
                                 "num long, language string, gd_path string")
    q = ingest_books(spark, root, meta, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    rows = spark.read.parquet(os.path.join(tmp_dir, "out")).collect()
    assert [(r.para, r.paragraph, r.language) for r in rows if r.num is None] == [(0, "nobody's", None)]
    got = sorted((r.num, r.para, r.paragraph, r.language) for r in rows if r.num is not None)
    assert got == [(1, 0, "One", "english"), (1, 1, "Two.", "english"),
                   (2, 0, "Drei", "german"), (2, 1, "Vier", "german")]


def test_compact_log_and_empty_table(spark, tmp_dir):
    from quire.sources.tables import QUERY_LOG_SCHEMA, empty_table
    p, out = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "log2")
    for i in range(3):
        QL.log_search(spark, p, "english", f"q{i}", 10, 1)
    QL.compact_log(spark, p, out)
    assert sorted(r.query for r in QL.read_log(spark, out).collect()) == ["q0", "q1", "q2"]
    many, wide = os.path.join(tmp_dir, "log3"), os.path.join(tmp_dir, "log4")
    QL.append_log(spark.range(400).select(*(e.alias(c) for c, e in (
        ("tab", F.lit("Search")), ("time", F.current_timestamp()), ("language", F.lit("english")),
        ("query", F.col("id").cast("string")), ("rows_returned_aka_limit", F.lit(1)), ("start_row_aka_offset", F.lit(1))))), many)
    QL.compact_log(spark, many, wide, files=4)
    assert len([f for f in os.listdir(os.path.join(wide, "tab=Search")) if f.endswith(".parquet")]) == 4
    e = empty_table(spark, QUERY_LOG_SCHEMA)
    assert e.count() == 0 and e.schema == QUERY_LOG_SCHEMA
