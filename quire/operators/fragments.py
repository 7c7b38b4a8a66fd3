"""Best fragments of a paragraph: excerpts built from the query's covers.

1. Every cover (``operators.covers``) is cut into fragments of at most ``words``
   words that begin and end with a query word.
2. Fragments are taken in order of most query words, then fewest words, then
   place; one that touches what is already taken is passed over, and
   ``max_fragments`` are enough.
3. A taken fragment is stretched to ``words`` words: to the left by half of what
   is missing, to the right by the rest, never into a fragment taken before. Each
   end is then drawn back to a word of more than ``short_word`` letters.
4. Fragments are joined in text order by ``' ... '``, their query words marked.

A paragraph without a cover shows its first ``min_words`` words. The limits and
the order are the documented behaviour of the reference's headline function with
``MaxFragments`` set; covers here are minimal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pieces
from .analysis import BoundQuery
from .covers import with_covers
from .matching import with_once

# The documented defaults of a headline's options.
MAX_WORDS = 35
MIN_WORDS = 15
SHORT_WORD = 3

_SPANS = "array<struct<s: int, e: int>>"


def cut_covers(words: int) -> str:
    """SQL: the fragments ``(items, words, s, e)`` of the covers, best first."""
    longer = ("transform(aggregate(filter(_hits, p -> p BETWEEN c.s AND c.e), cast(array() AS array<struct<s: int, e: int, n: int>>), "
              f"(acc, p) -> IF(size(acc) > 0 AND p - element_at(acc, -1).s < {words}, "
              "concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', p, 'n', element_at(acc, -1).n + 1))), "
              "array_append(acc, named_struct('s', p, 'e', p, 'n', 1)))), f -> f)")
    parts = f"transform(covers, c -> IF(c.e - c.s < {words}, array(c), {longer}))"
    return (f"array_sort(array_distinct(transform(flatten({parts}), "
            "f -> named_struct('items', -f.n, 'words', f.e - f.s + 1, 's', f.s, 'e', f.e))))")


def choose(words: int, short_word: int, max_fragments: int) -> str:
    """SQL: the taken and stretched fragments ``(s, e)`` of ``_frags``, in text order."""
    floor = "coalesce(array_max(transform(filter(acc, c -> c.e < f.s), c -> c.e)) + 1, 0)"
    ceiling = "coalesce(array_min(transform(filter(acc, c -> c.s > f.e), c -> c.s)) - 1, size(_long) - 1)"
    reach = f"greatest(f.s - greatest({words} - f.words, 0) DIV 2, {floor})"
    start = f"array_min(filter(sequence(int({reach}), f.s), i -> i = f.s OR _long[i]))"
    end = (f"array_max(filter(sequence(f.e, greatest(f.e, least(int(a + {words - 1}), {ceiling}))), "
           "i -> i = f.e OR _long[i]))")
    stretched = f"element_at(transform(array({start}), a -> named_struct('s', a, 'e', {end})), 1)"
    taken = (f"aggregate(_frags, cast(array() AS {_SPANS}), (acc, f) -> "
             f"IF(size(acc) >= {max_fragments} OR exists(acc, c -> c.s <= f.e AND f.s <= c.e), acc, "
             f"array_append(acc, {stretched})))")
    return f"array_sort({taken})".replace("_long[i]", f"_long[i] > {short_word}")


def with_fragments(df: DataFrame, text: str, q: BoundQuery, phrase: bool = True, out: str = "h",
                   words: int = MAX_WORDS, min_words: int = MIN_WORDS, short_word: int = SHORT_WORD,
                   max_fragments: int = 1000, only_matches: bool = False, start_sel: str = "**",
                   stop_sel: str = "**", delimiter: str = " ... ") -> DataFrame:
    """Add the excerpt ``out`` of text column ``text``; NULL text gives NULL.

    ``phrase``: the query is a phrase, else all its words; ``only_matches``
    marks of a phrase only its occurrences' own words. Without query lexemes
    the paragraph has no cover.
    """
    d = with_covers(df, text, q, phrase, out="covers")
    d = with_once(d, _frags=F.expr(cut_covers(words)), _ps=pieces(F.col(text)))
    d = with_once(d, _w0=F.expr(r"IF(get(_ps, 0) RLIKE '^[\\p{L}\\p{N}]', 0, 1)"))
    d = with_once(d, _long=F.expr("transform(filter(_ps, (x, i) -> i % 2 = _w0), x -> length(x))"))
    own = ", ".join(f"c.s + {off}" for off in sorted({o for _, o in q.terms}))
    marks = f"array_distinct(flatten(transform(covers, c -> array({own}))))" if only_matches and phrase and q.terms else "_hits"
    d = with_once(d, _marks=F.expr(marks))
    first = f"IF(size(_long) > 0, array(named_struct('s', 0, 'e', least(size(_long), {min_words}) - 1)), cast(array() AS {_SPANS}))"
    d = with_once(d, _spans=F.expr(f"IF(size(_frags) > 0, {choose(words, short_word, max_fragments)}, {first})"))

    def show(span):
        def piece(x, i):
            word = (i % 2 == 0) & F.array_contains("_marks", (span["s"] + (i / 2)).cast("int"))
            return F.when(word, F.concat(F.lit(start_sel), x, F.lit(stop_sel))).otherwise(x)
        inside = F.slice("_ps", F.col("_w0") + span["s"] * 2 + 1, (span["e"] - span["s"]) * 2 + 1)
        return F.array_join(F.transform(inside, piece), "")

    body = F.array_join(F.transform("_spans", show), delimiter)
    return (d.withColumn(out, F.when(F.col(text).isNotNull(), body))
            .drop("covers", "_lx", "_hits", "_frags", "_ps", "_w0", "_long", "_marks", "_spans"))
