"""Paragraph analysis into positioned lexemes, and query analysis.

``analyze`` is the re-expression of the reference's lexeme vectors: one row
per kept token ``(language, num, para, ti, lexeme)``. It is one narrow
generator over the paragraph rows (no shuffle); stopwords are an ``IN`` over
a fixed list inside the generated code, not a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import (LANGUAGE_CONFIGS, TextConfig, config, lexemes_of, spark_sql_str,
                              sql_known_word, sql_stem_by_language, tokens)


def tokenize(paragraphs: DataFrame, keys=("num", "para")) -> DataFrame:
    """``keys..., ti, token`` for every token of every paragraph."""
    return paragraphs.select(*keys, F.posexplode(tokens(F.col("paragraph")))
                             .alias("ti", "token"))


def analyze(paragraphs: DataFrame, catalogue=LANGUAGE_CONFIGS, stem: bool = True) -> DataFrame:
    """``language, num, para, ti, lexeme`` for paragraphs with an analyser.

    ``language`` names the analyser, one of ``catalogue``; paragraphs without
    one get no lexemes, as the reference leaves their vector NULL. Without
    ``stem`` a lexeme is the lower-cased word (for ``operators.vocabulary``).
    """
    # lower-cased once, in the array, and tested for stopwords once: a condition on
    # the lexeme would be pushed below it and evaluate the whole expression again
    words = F.transform(tokens(F.col("paragraph")), lambda t: F.lower(t))
    known = (paragraphs.where(F.col("language").isNotNull())
             .select("language", "num", "para", F.posexplode(words).alias("ti", "word"))
             .where(sql_known_word("word", "language", catalogue)))
    lexeme = F.expr(sql_stem_by_language("word", "language", catalogue) if stem else "word")
    return known.select("language", "num", "para", "ti", lexeme.alias("lexeme"))


def normalize_with_dictionary(analyzed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The ``dictionary`` normaliser: replace lexemes found in a word list.

    ``dictionary`` is ``(language, word, lexeme)``, e.g. a stemmer's output
    computed once over the *distinct* vocabulary (``lexeme_stats``) rather
    than once per token. Words not in it keep their lexeme. How the two sides
    meet is left to the optimizer, which knows their bytes.
    """
    d = dictionary.select("language", F.col("word").alias("lexeme"), F.col("lexeme").alias("_norm"))
    cols = [F.coalesce(F.col("_norm"), F.col("lexeme")).alias("lexeme") if c == "lexeme" else F.col(c)
            for c in analyzed.columns]
    return analyzed.join(d, ["language", "lexeme"], "left").select(*cols)


def query_terms(spark: SparkSession, queries: DataFrame | list[tuple[int, str]] | str,
                cfg: TextConfig | str) -> DataFrame:
    """``query_id, lexeme, offset``: the phrase-query form of each query text.

    ``queries`` is a DataFrame ``(query_id, query)`` (or a list / one string).
    The same analyser as the paragraphs is applied. Offsets count stopwords
    (``a to b`` gives offsets 0 and 2) and are shifted so the first kept term
    has offset 0. A query of stopwords only has no rows, so it matches nothing.
    """
    cfg = config(cfg) if isinstance(cfg, str) else cfg
    if isinstance(queries, str):
        queries = [(0, queries)]
    if not isinstance(queries, DataFrame):
        queries = spark.createDataFrame(queries, "query_id long, query string")
    t = (queries.select("query_id", F.posexplode(lexemes_of("query", cfg, empty_for_stop=False))
                        .alias("pos", "lexeme"))
         .where(F.col("lexeme").isNotNull()))
    w = Window.partitionBy("query_id")
    return t.select("query_id", "lexeme",
                    (F.col("pos") - F.min("pos").over(w)).alias("offset"))


@dataclass(frozen=True)
class BoundQuery:
    """A query analysed once and bound as literals into a plan.

    ``terms`` are ``(lexeme, offset)`` pairs ordered by offset. A query
    string is short user input, so its terms are bounded by its length.
    """
    text: str
    config: TextConfig
    terms: tuple[tuple[str, int], ...]

    @property
    def lexemes(self) -> tuple[str, ...]:
        return tuple(sorted({lx for lx, _ in self.terms}))

    @property
    def span(self) -> int:
        """Positions a phrase occurrence covers (last offset + 1)."""
        return max(o for _, o in self.terms) + 1 if self.terms else 0

    @property
    def size(self) -> int:
        return len(self.terms)


def bind_query(spark: SparkSession, text: str, cfg: TextConfig | str,
               dictionary: DataFrame | None = None) -> BoundQuery:
    """Analyse ``text`` with the corpus's own expressions and bind it.

    The analysis is a projection over an inline table, which the optimizer
    evaluates on the driver (no job is scheduled); offsets are then shifted so
    the first kept term is at 0. With ``dictionary`` (as the index was built
    with) its entries for these few words are looked up.
    """
    cfg = config(cfg) if isinstance(cfg, str) else cfg
    q = spark.sql(f"SELECT query FROM VALUES ({spark_sql_str(text)}) AS q(query)")
    row = q.select(lexemes_of("query", cfg, empty_for_stop=False).alias("lx")).collect()[0]
    kept = [(lx, i) for i, lx in enumerate(row["lx"] or []) if lx is not None]
    if dictionary is not None and kept:
        norm = {r["word"]: r["lexeme"] for r in dictionary.where(
            (F.col("language") == cfg.name) & F.col("word").isin([lx for lx, _ in kept])).collect()}
        kept = [(norm.get(lx, lx), i) for lx, i in kept]
    base = kept[0][1] if kept else 0
    return BoundQuery(text, cfg, tuple((lx, i - base) for lx, i in kept))
