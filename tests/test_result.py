"""The filter row of a result table, stored order, CSV of any text."""

import datetime as dt

from pyspark.sql import functions as F

from quire.operators.result import filter_result
from quire.sources.sinks import export_csv, file_bounds, read_csv, stored_places, write_ordered

ROWS = [(1, "Ann Lee", 4.5, dt.date(2020, 1, 5)), (2, "ann", 5.0, dt.date(2021, 3, 1)), (3, None, None, None),
        (4, "", 10.0, dt.date(2020, 12, 31)), (5, "> 5", 5.5, dt.date(1999, 1, 1))]


def ids(df, **conditions):
    return sorted(r["id"] for r in filter_result(df, conditions).collect())


def test_conditions(spark):
    df = spark.createDataFrame(ROWS, "id int, name string, rank double, day date")
    assert ids(df, rank="> 5") == [4, 5] and ids(df, rank=">=5") == [2, 4, 5] and ids(df, rank="lt 5") == [1]
    assert ids(df, rank="5") == [2] and ids(df, rank="!= 5") == [1, 4, 5] and ids(df, rank="eq 5.50") == [5]
    assert ids(df, rank="abc") == [] and ids(df, rank="") == [1, 2, 3, 4, 5]
    assert ids(df, name="ann") == [2] and ids(df, name="icontains ANN") == [1, 2] and ids(df, name="contains L") == [1]
    assert ids(df, name='= "ann"') == [2] and ids(df, name="!= 'ann'") == [1, 4, 5] and ids(df, name="'> 5'") == [5]
    assert ids(df, name="is blank") == [3, 4] and ids(df, name="is not blank") == [1, 2, 5]
    assert ids(df, day="datestartswith 2020") == [1, 4] and ids(df, day=">= 2020-12-31") == [2, 4]
    assert ids(df, name="icontains ann", rank="< 5") == [1] and ids(df, rank="is blank") == [3]


def test_a_stored_table_keeps_its_order(spark, tmp_dir):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), "id").repartition(5)
    path = write_ordered(df, f"{tmp_dir}/t", F.col("k").desc())
    assert [(r["k"], r["place"]) for r in stored_places(spark, path).orderBy("place").collect()] == [(999 - i, i + 1) for i in range(1000)]
    bounds = sorted((r["file"], r["low"], r["high"], r["rows"]) for r in file_bounds(spark, path, "k").collect())
    assert sum(b[3] for b in bounds) == 1000
    assert all(a[1] > b[2] for a, b in zip(bounds, bounds[1:]))  # files don't overlap


def test_csv_reads_back_any_text(spark, tmp_dir):
    rows = [(1, 'a "b", c'), (2, "line\nend \\ \" x\n"), (3, "  spaces  "), (4, ""), (5, None), (6, '"'), (7, "\\"), (8, ",,\n,")]
    df = spark.createDataFrame(rows, "id int, text string")
    back = read_csv(spark, export_csv(df, f"{tmp_dir}/c"), df.schema)
    assert sorted(tuple(r) for r in back.collect()) == [(i, t or None) for i, t in rows]
