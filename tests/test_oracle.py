"""Every registered query against its DuckDB oracle, on the smallest tables."""

import pytest

import __spark_entry__ as E
from quire.plans import registry
from oracle_check import compare, duck_connection

from conftest import SF_SMALL

KEYS = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.queries())
    assert set(registry.queries()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and df.columns == ["author", "title", "num", "relevant_paragraphs", "rank"]


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    ok, detail = compare(spark, SF_SMALL, key, con, verbose=False)
    assert ok, (key, len(detail[1]), len(detail[3]))
