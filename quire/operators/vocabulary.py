"""The vocabulary job: every distinct word of a language is stemmed once.

``build_dictionary`` reduces the text to its distinct ``(language, word)`` on the
map side, then stems each word with the language's suffix stages
(``functions.stemming``): the costly expressions run over the vocabulary, not
over the tokens. The result ``(language, word, lexeme, occurrences)`` is joined
to the tokens when an index is built, and expands a query: its words are
stemmed, and every word of the vocabulary with such a stem becomes a form of
the query, which scan search, ranking and headlines then match word by word.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stemming import STEMMERS, stem_column
from ..functions.text import LANGUAGE_CONFIGS, lexemes_of, spark_sql_str, words_config
from .analysis import BoundQuery, analyze


def vocabulary(paragraphs: DataFrame, catalogue=LANGUAGE_CONFIGS) -> DataFrame:
    """``language, word, occurrences``: distinct lower-cased words, no stopwords."""
    words = analyze(paragraphs, catalogue, stem=False)
    return words.groupBy("language", F.col("lexeme").alias("word")).agg(F.count("*").alias("occurrences"))


def build_dictionary(words: DataFrame, catalogue=LANGUAGE_CONFIGS) -> DataFrame:
    """``language, word, lexeme, occurrences`` of a ``vocabulary`` (best a written one).

    A language without a stemmer keeps its words as lexemes.
    """
    out = words.where(~F.col("language").isin(list(STEMMERS))).withColumn("lexeme", F.col("word"))
    for language in catalogue:
        if language in STEMMERS:
            out = out.unionByName(stem_column(words.where(F.col("language") == language), language))
    return out.select("language", "word", "lexeme", "occurrences")


def analyze_stemmed(paragraphs: DataFrame, dictionary: DataFrame, catalogue=LANGUAGE_CONFIGS) -> DataFrame:
    """``analyze`` with the lexemes of a dictionary of the paragraphs.

    A word that isn't in the dictionary keeps its own form. How the two sides
    meet is the optimizer's choice by their bytes; the frequent words of a
    shuffled join are spread by the adaptive plan.
    """
    words = analyze(paragraphs, catalogue, stem=False).withColumnRenamed("lexeme", "word")
    known = dictionary.select("language", "word", F.col("lexeme").alias("stemmed"))
    return (words.join(known, ["language", "word"], "left")
            .select("language", "num", "para", "ti", F.coalesce("stemmed", "word").alias("lexeme")))


def bind_stemmed(spark: SparkSession, text: str, language: str, dictionary: DataFrame | None = None) -> BoundQuery:
    """``bind_query`` by stems: the words are stemmed on the driver's one row.

    With ``dictionary`` the query's analyser knows exactly the words of the
    vocabulary that share a stem with the query (a few per query word), so it
    can be matched against text as it stands; without, it is for an index whose
    lexemes are stems.
    """
    cfg = words_config(language)
    q = spark.sql(f"SELECT query FROM VALUES ({spark_sql_str(text)}) AS q(query)")
    pos = q.select(F.posexplode(lexemes_of("query", cfg, empty_for_stop=False)).alias("pos", "word"))
    rows = stem_column(pos.where("word IS NOT NULL"), language).orderBy("pos").collect()
    base = rows[0]["pos"] if rows else 0
    terms = tuple((r["lexeme"], r["pos"] - base) for r in rows)
    if dictionary is not None and terms:
        own = dictionary.where((F.col("language") == language) & F.col("lexeme").isin(sorted({lx for lx, _ in terms})))
        cfg = replace(cfg, forms=tuple(sorted({(r["word"], r["lexeme"]) for r in own.select("word", "lexeme").collect()})))
    return BoundQuery(text, cfg, terms)
