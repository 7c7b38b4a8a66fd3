"""Constraints of the reference re-aimed as data-quality checks.

Spark enforces no keys; these jobs report violations instead: one
aggregation (unique key) and one anti join (reference) each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return (df.groupBy(*keys).agg(F.count("*").alias("count"))
            .where(F.col("count") > 1))


def check_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row: rows, distinct keys, duplicated keys, rows with a NULL key."""
    null_key = None
    for k in keys:
        c = F.col(k).isNull()
        null_key = c if null_key is None else null_key | c
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(null_key.cast("int")).alias("has_null"))
    return per_key.agg(
        F.lit(name).alias("check"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        F.count("*").alias("keys"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("has_null") == 1, F.col("n"))), F.lit(0)).cast("bigint").alias("null_key_rows"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent (anti join; NULL keys are orphans)."""
    return child.join(parent.select(key).distinct(), on=key, how="left_anti")


def check_reference(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """One row: child rows and orphan rows for a foreign key (one left join)."""
    found = parent.select(key).distinct().withColumn("_found", F.lit(True))
    j = child.select(key).join(found, on=key, how="left")
    return j.agg(F.lit(name).alias("check"), F.count("*").alias("rows"),
                 F.count_if(F.col("_found").isNull()).alias("orphans"))
