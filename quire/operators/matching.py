"""Full-text match predicates: phrase (exact distances) and all-words.

Two physical forms of the same definitions:

- *scan form* (``phrase_match`` / ``all_words_match``): per paragraph, with
  array functions over the paragraph's lexemes and the query bound as
  literals. A cheap substring pre-filter (a necessary condition) drops most
  paragraphs before any tokenising. Narrow: no join, no shuffle.
- *postings form* (``phrase_match_postings`` / ``all_words_match_postings``):
  postings joined to a term table, grouped by ``(query_id, num, para, ti -
  offset)``. Used for many queries at once; which side is broadcast is decided
  by bytes at run time, or by the number of query words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TextConfig, lexemes_of
from ..session import scratch_path
from ..sources.sinks import write_table
from .analysis import BoundQuery


def lexeme_array(paragraph: str, cfg: TextConfig) -> Column:
    """Lexemes of text column ``paragraph`` by position; '' for a stopword."""
    return lexemes_of(paragraph, cfg)


def _probe(lx: str, cfg: TextConfig) -> str:
    """A substring every token with lexeme ``lx`` contains (lowercased).

    The S-stemmer maps ``-ies`` to ``-y``, so a lexeme ending in ``y`` may come
    from a word without that ``y``; every other rule only removes a suffix.
    """
    if cfg.stemmer == "s" and lx.endswith("y"):
        return lx[:-1]
    return lx


def prefilter(paragraph: Column, q: BoundQuery) -> Column:
    """Necessary condition for any match: every term's probe is a substring."""
    low = F.lower(paragraph)
    cond = F.lit(True)
    for lx in q.lexemes:
        if q.config.forms is not None:
            words = [w for w, lexeme in q.config.forms if lexeme == lx]
            some = F.lit(False)
            for w in words:
                some = some | low.contains(w)
            cond = cond & some
            continue
        p = _probe(lx, q.config)
        if p:
            cond = cond & low.contains(p)
    return cond


def with_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    The optimizer substitutes a projected expression into every later use,
    including inside lambda functions, where it would be re-evaluated per
    array element. Passing the values through a one-element ``inline``
    generator makes them plain attributes for everything above it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def phrase_count(lexemes: Column, q: BoundQuery) -> Column:
    """Number of start positions where every term sits at its offset.

    The lexeme array is aligned with itself shifted by each offset
    (``arrays_zip`` of slices), so each occurrence is one zipped element whose
    fields all equal their terms: one pass over the paragraph per term.
    """
    n = F.size(lexemes)
    shifted = [F.slice(lexemes, off + 1, n) for _, off in q.terms]
    zipped = F.arrays_zip(*shifted)

    def hit(s):
        cond = None
        for k, (lx, _) in enumerate(q.terms):
            c = s.getField(str(k)) == F.lit(lx)
            cond = c if cond is None else cond & c
        return F.coalesce(cond, F.lit(False))

    return F.size(F.filter(zipped, hit))


def phrase_match(paragraphs: DataFrame, q: BoundQuery) -> DataFrame:
    """Paragraphs containing the phrase, with ``n_matches`` (occurrences)."""
    if not q.terms:
        return paragraphs.where(F.lit(False)).withColumn("n_matches", F.lit(0))
    cand = with_once(paragraphs.where(prefilter(F.col("paragraph"), q)),
                     lexemes=lexeme_array("paragraph", q.config))
    return (cand.withColumn("n_matches", phrase_count(F.col("lexemes"), q))
            .where(F.col("n_matches") > 0).drop("lexemes"))


def all_words_match(paragraphs: DataFrame, q: BoundQuery) -> DataFrame:
    """Paragraphs containing every term, in any order and place."""
    if not q.terms:
        return paragraphs.where(F.lit(False))
    cand = with_once(paragraphs.where(prefilter(F.col("paragraph"), q)),
                     lexemes=lexeme_array("paragraph", q.config))
    cond = F.lit(True)
    for t in q.lexemes:
        cond = cond & F.array_contains(F.col("lexemes"), F.lit(t))
    return cand.where(cond).drop("lexemes")


# ---------------------------------------------------------------- postings form

def explode_positions(postings: DataFrame) -> DataFrame:
    """Grouped postings ``(.., positions)`` -> one row per position ``ti``."""
    if "ti" in postings.columns:
        return postings
    return postings.withColumn("ti", F.explode("positions")).drop("positions")


def term_table(spark, q: BoundQuery, query_id: int = 0) -> DataFrame:
    return spark.createDataFrame([(query_id, lx, off) for lx, off in q.terms],
                                 "query_id long, lexeme string, offset int")


def phrase_match_postings(postings: DataFrame, terms: DataFrame, on=("lexeme",)) -> DataFrame:
    """``query_id, num, para, n_matches`` from positional postings.

    ``terms`` is (query_id, lexeme, offset [, language]); the aggregation is
    partial (map-side) first and only matched candidates cross the network.
    ``on`` are the join columns (add ``language`` when the terms differ per
    analyser).
    A phrase occurrence starts at ``ti - offset`` and is complete when every
    offset of the query is present there. A position holds one lexeme, so
    each term adds at most one row per start: ``count(*)`` counts the
    distinct offsets found without a distinct aggregate.
    """
    on = list(on)
    qkeys = ["query_id"] + [c for c in on if c != "lexeme"]
    n = terms.groupBy(*qkeys).agg(F.countDistinct("offset").alias("n_terms"))
    t = terms.join(n, qkeys)
    hits = (explode_positions(postings).join(t, on=on)
            .groupBy("query_id", "num", "para", (F.col("ti") - F.col("offset")).alias("start"))
            .agg(F.count("*").alias("found"), F.first("n_terms").alias("n_terms"))
            .where(F.col("found") == F.col("n_terms")))
    return hits.groupBy("query_id", "num", "para").agg(F.count("*").alias("n_matches"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(write_table(df, scratch_path(spark, name)))


def numbered(df: DataFrame, number: str, name: str) -> DataFrame:
    """``df``, written, with a column ``number`` of integers from 0 on without gaps."""
    rows = _stored(df.withColumn("_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("_row", 33)
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = rows.groupBy(part.alias("_part")).count().select("_part", F.coalesce(before, F.lit(0)).alias("_first"))  # a row a partition
    at = F.col("_first") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(F.broadcast(first), "_part").select(*df.columns, at.cast("int").alias(number))


# Words of queries that are broadcast at most (some 100 MB); of more the joins go by bytes.
FEW_TERMS = 1 << 20


def phrase_starts_rare_first(postings: DataFrame, terms: DataFrame, freq: DataFrame | None = None,
                             on=("lexeme",)) -> DataFrame:
    """``query_id, num, para, start``: every occurrence of every query, anchored
    on the query's rarest term (for many queries with common words, e.g. names).

    1. The words of the queries are numbered; of the positions only those of
       such words go on, as a number each: ``ti`` and the word.
    2. ``freq`` (``on`` columns + ``n``: corpus frequency; counted here without)
       ranks each query's terms; the rarest is its anchor (a term absent from
       ``freq`` makes the query unmatchable, and it is dropped here).
    3. The positions are gathered per paragraph, which is the one shuffle of
       them. Each one that has an anchor's word is a candidate start, and every
       candidate is verified there: each term at its distance from the anchor.

    Words and anchors with their terms are broadcast up to ``FEW_TERMS``; the
    candidates of more are shuffled to their paragraphs. Of repeated positions
    with different lexemes each one counts; a position without ``num`` or ``para``
    is in no paragraph.
    """
    on = list(on)
    qkeys = ["query_id"] + [c for c in on if c != "lexeme"]
    pkeys = [c for c in on if c != "lexeme"] + ["num", "para"]
    words = numbered(terms.select(*on).distinct(), "word", "words")
    coded = _stored(terms.join(words, on).select(*qkeys, "word", "offset"), "terms")
    few = coded.count() <= FEW_TERMS
    known = explode_positions(postings.join(F.broadcast(words) if few else words, on)).select(*pkeys, "ti", "word")
    n = freq.join(words, on).select("word", "n") if freq is not None else known.groupBy("word").agg(F.count("*").alias("n"))
    queries = (coded.join(n, "word", "left").groupBy(*qkeys)
               .agg(F.min(F.struct("n", "offset", "word")).alias("rare"), F.collect_list(F.struct("offset", "word")).alias("terms"))
               .where("rare.n IS NOT NULL"))
    # two integers in a long: the distance from the anchor and the word
    away = "transform(terms, t -> shiftleft(bigint(t.offset - rare.offset), 32) | t.word)"
    anchors = _stored(queries.select("query_id", "rare.word", "rare.offset", F.expr(away).alias("terms")), "anchors")
    packed = F.expr("shiftleft(bigint(ti), 32) | word")
    near = known.dropna(subset=pkeys).groupBy(*pkeys).agg(F.sort_array(F.collect_set(packed)).alias("has"))
    near = with_once(near, base=F.expr("int(shiftright(has[0], 32))"),
                     again=F.expr("filter(has, (x, i) -> i > 0 AND shiftright(x, 32) = shiftright(get(has, i - 1), 32))"))
    once = F.expr("if(size(again) = 0, has, array_except(has, again))")
    # the words by place, -1 where there is none
    gap = "int(shiftright(x, 32) - coalesce(shiftright(get(once, i - 1), 32) + 1, base))"
    at = F.expr(f"flatten(transform(once, (x, i) -> concat(array_repeat(-1, {gap}), array(int(x & 4294967295L)))))")
    near = with_once(with_once(near, once=once), at=at).drop("once")
    each = near.withColumn("x", F.explode("has")).withColumn("word", F.expr("int(x & 4294967295L)")).withColumn("ti", F.expr("int(shiftright(x, 32))"))
    if few:
        starts = each.join(F.broadcast(anchors), "word")
    else:
        starts = each.select(*pkeys, "word", "ti").join(anchors, "word").join(near, pkeys)
    there = F.expr("forall(terms, t -> coalesce(get(at, int(ti - base + shiftright(t, 32))) = int(t & 4294967295L), false)"
                   " OR (size(again) > 0 AND array_contains(again, t + shiftleft(bigint(ti), 32))))")
    return starts.where(there).select("query_id", "num", "para", (F.col("ti") - F.col("offset")).alias("start"))


def phrase_match_rare_first(postings: DataFrame, terms: DataFrame, freq: DataFrame | None = None,
                            on=("lexeme",)) -> DataFrame:
    """Same result as ``phrase_match_postings`` for the paragraphs that have a key,
    by ``phrase_starts_rare_first``."""
    starts = phrase_starts_rare_first(postings, terms, freq, on)
    return starts.groupBy("query_id", "num", "para").agg(F.count("*").alias("n_matches"))


def all_words_match_postings(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, num, para`` where every distinct term lexeme occurs."""
    n = terms.groupBy("query_id").agg(F.countDistinct("lexeme").alias("n_terms"))
    t = terms.select("query_id", "lexeme").distinct().join(n, "query_id")
    p = postings.select("num", "para", "lexeme")
    if "positions" not in postings.columns:  # one row per position: reduce first
        p = p.distinct()
    return (p.join(t, on="lexeme")
            .groupBy("query_id", "num", "para")
            .agg(F.count("*").alias("found"), F.first("n_terms").alias("n_terms"))
            .where(F.col("found") == F.col("n_terms"))
            .select("query_id", "num", "para"))
