"""Findings of round 3: what they asked for, on rows of their own."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quire.operators import postings as PO
from quire.operators.analysis import analyze
from quire.sources import files as FS
from quire.sources import json_blocks as JB


def test_small_blocks_share_tasks(spark, tmp_path):
    path = str(tmp_path / "arrays")
    array = "[" + ", ".join('{"Num": %d, "Title": ["a, }] %d"]}' % (i, i) for i in range(4000)) + "]"
    spark.createDataFrame([(0, array), (1, array)], "part int, value string").write.partitionBy("part").text(path)
    with JB.split_bytes(spark, 256):
        pieces = JB._pieces(spark, path)
        blocks = pieces.select("file", "block").distinct().count()
        got = JB.read_json_array(spark, path).select(F.get_json_object("metadata", "$.Num").cast("int").alias("n"))
        assert pieces.rdd.getNumPartitions() <= max(spark.sparkContext.defaultParallelism, 2) < blocks
        assert sorted(r["n"] for r in got.collect()) == sorted(list(range(4000)) * 2)


def test_book_files_few_folders_and_no_walk(spark, tmp_path):
    root = str(tmp_path / "files")
    books = spark.createDataFrame([(i, None if i == 3 else f"text {i}\nend") for i in range(30)] + [(7, "again")], "num long, content string")
    made = {r["num"]: r["gd_path"] for r in FS.write_book_files(books, root, 10).collect()}
    assert sorted(os.listdir(root)) == ["0", "1", "2"] and made[25] == "2/25.txt"
    meta = spark.createDataFrame([*made.items(), (99, "gone/99.txt")], "num long, gd_path string")
    got = {r["num"]: r["content"] for r in FS.read_contents(spark, meta, root).collect()}
    assert got[3] == "" and got[99] == "" and got[25] == "text 25\nend" and got[7] == "again\ntext 7\nend" and len(got) == 31
    assert FS.empty_files(spark, root) == []
    assert [tuple(r) for r in FS.content_report(spark, meta, root).collect()] == [(99, "gone/99.txt", "missing")]
    open(os.path.join(root, "0", "none.txt"), "w").close()
    assert FS.empty_files(spark, root) == ["0/none.txt"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_lowered_and_tested_once(spark):
    rows = [(1, 0, "english", "The CATS and Ponies of İs"), (2, 0, "french", "Les Chats"), (3, 0, None, "none")]
    paras = spark.createDataFrame(rows, "num long, para int, language string, paragraph string")
    got = analyze(paras)
    assert _plan(got).count("lower(") == 1
    found = {(r["num"], r["ti"], r["lexeme"]) for r in got.collect()}
    assert found == {(1, 1, "cat"), (1, 3, "pony"), (1, 5, "i̇"), (2, 1, "chats")}


def test_statistics_count_repeated_rows(spark):
    rows = [(1, 0, "english", "cats cat dog"), (1, 0, "english", "cats cat dog"), (2, 0, "german", "Cats"), (None, 0, "english", "dogs")]
    paras = spark.createDataFrame(rows, "num long, para int, language string, paragraph string")
    got = {tuple(r) for r in PO.paragraph_stats(paras).collect()}
    assert got == {("english", "cat", 2, 4), ("english", "dog", 3, 3), ("german", "cats", 1, 1)}


def test_positions_are_sorted_in_their_files(spark, tmp_path):
    books = spark.createDataFrame([(i, "English", f"word{i % 7} tree word{i % 3}.\nhouse tree") for i in range(40)], "num long, language string, content string")
    out = PO.build_index(spark, books, str(tmp_path / "index"), buckets=5, blocks=2)
    key = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    assert key == "0"  # set back after the write
    for r in (spark.read.parquet(out["postings"]).groupBy(F.col("_metadata.file_path").alias("f"))
              .agg(F.array_sort(F.collect_list(F.struct(F.col("_metadata.row_index").alias("at"), "lexeme", "num", "para", "ti"))).alias("rows")).collect()):
        keys = [(x["lexeme"], x["num"], x["para"], x["ti"]) for x in r["rows"]]
        assert keys == sorted(keys)
