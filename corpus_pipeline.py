"""The corpus pipeline: stages of the training-data operators over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, packing, pii, quality, simhash_dedup
from quire.llm.common import fresh, table, written


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the quality sample go."""
    return quality.resample(docs, table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs).where("kept").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays: the smallest doc_id.

    A row is its doc_id and text: of repeated ids with different texts each is
    judged by its own group, the text's MD5 decides inside one; a null id stays
    only in a group without ids. Of rows with equal id and text one stays.
    """
    digest, group, best = fresh(docs, "digest", "group", "best")
    keyed = docs.withColumn(digest, F.md5("text"))
    rows = keyed.select("doc_id", "text", digest)
    found = written(simhash_dedup.simhash_dedup(rows, group=group).select("doc_id", digest, group), "near")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(digest).alias("digest"))
    first = found.groupBy(group).agg(F.min(order).alias(best)).select(f"{best}.*")
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(first["id"]) & keyed[digest].eqNullSafe(first["digest"]), "left_semi")
    if not found.groupBy("doc_id", digest).count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", digest])
    return kept.select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) \
        if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The segments of every document with their text, dealt into token-budget batches."""
    return packing.pack(docs.select("doc_id", "text"), with_text=True)


STAGES = [("quality classifier", accept), ("exact dedup", exact), ("near dedup", near), ("pii", redacted), ("packing", packed)]

#: SimHash components and resampling are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
