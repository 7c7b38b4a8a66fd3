"""Covers: the shortest stretches of a paragraph in which a query holds.

A *hit* is a position whose lexeme is one of the query's. For a phrase every
occurrence is a cover. For an all-words query a cover is an interval that has
every lexeme and holds no shorter such interval: with the right end moving from
hit to hit, the left end is the earliest of the lexemes' latest hits so far, and
the interval is minimal when that left end has moved. ``n`` counts the hits in
the cover; the other positions in it are its *noise*.

All arrays are built row by row from the paragraph's own lexemes, without
exploding it: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lexemes_of, spark_sql_str
from .analysis import BoundQuery
from .matching import with_once

_COVERS = "array<struct<s: int, e: int, n: int>>"


def _in_list(q: BoundQuery) -> str:
    return "(" + ", ".join(spark_sql_str(lx) for lx in q.lexemes) + ")"


def with_lexemes(df: DataFrame, text: str, q: BoundQuery) -> DataFrame:
    """Add ``_lx`` (lexemes by position) and ``_hits`` (positions of hits, rising)."""
    d = with_once(df, _lx=lexemes_of(text, q.config))
    hits = f"filter(transform(_lx, (x, i) -> IF(x IN {_in_list(q)}, i, -1)), i -> i >= 0)"
    return with_once(d, _hits=F.expr(hits))


def phrase_covers(q: BoundQuery) -> Column:
    """Occurrences of the phrase as ``(s, e, n)`` from ``_lx`` and ``_hits``."""
    there = " AND ".join(f"coalesce(get(_lx, st + {off}) = {spark_sql_str(lx)}, false)" for lx, off in q.terms)
    n = f"size(filter(slice(_lx, st + 1, {q.span}), x -> x IN {_in_list(q)}))"
    return F.expr(f"transform(filter(_hits, st -> {there}), "
                  f"st -> named_struct('s', st, 'e', st + {q.span - 1}, 'n', {n}))")


def word_covers(q: BoundQuery) -> Column:
    """Minimal intervals with every lexeme as ``(s, e, n)`` from ``_lx`` and ``_hits``.

    One pass over the hits keeps the number of each lexeme's latest hit; the
    least of them is the left end that belongs to a hit as the right end.
    """
    number = "CASE element_at(_lx, p + 1) " + " ".join(
        f"WHEN {spark_sql_str(lx)} THEN {j}" for j, lx in enumerate(q.lexemes)) + " END"
    latest = "transform(acc.last, (l, j) -> IF(j = h.t, h.i, l))"
    lefts = (f"aggregate(transform(_hits, (p, i) -> named_struct('i', i, 't', {number})), "
             f"named_struct('last', array_repeat(-1, {len(q.lexemes)}), 'lefts', cast(array() AS array<int>)), "
             f"(acc, h) -> named_struct('last', {latest}, 'lefts', array_append(acc.lefts, array_min({latest}))), "
             f"acc -> acc.lefts)")
    ends = "transform(l, (x, i) -> named_struct('l', x, 'r', i, 'new', x >= 0 AND (i = 0 OR x > l[i - 1])))"
    covers = (f"transform(filter({ends}, c -> c.new), c -> named_struct("
              f"'s', _hits[c.l], 'e', _hits[c.r], 'n', c.r - c.l + 1))")
    return F.expr(f"element_at(transform(array({lefts}), l -> {covers}), 1)")


def with_covers(df: DataFrame, text: str, q: BoundQuery, phrase: bool = True, out: str = "covers") -> DataFrame:
    """Add ``out``, the covers ``(s, e, n)`` of the query in text column
    ``text`` from left to right, and ``_lx``, ``_hits``.

    Positions count every token from 0, ``s`` and ``e`` included. NULL text and
    a query without lexemes have no covers.
    """
    if not q.terms:
        return df.select("*", F.lit(None).cast("array<string>").alias("_lx"), F.expr("cast(array() AS array<int>)").alias("_hits"),
                         F.expr(f"cast(array() AS {_COVERS})").alias(out))
    covers = phrase_covers(q) if phrase else word_covers(q)
    return with_once(with_lexemes(df, text, q), **{out: F.coalesce(covers, F.expr(f"cast(array() AS {_COVERS})"))})
