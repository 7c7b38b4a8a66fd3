"""Highlighted excerpts: query terms wrapped in ``**`` markers.

The text is cut into alternating words and gaps with one regular
expression; a word is marked when its lexeme (under the query's analyser)
is a query lexeme. Marking works on the token list, not on ``\\b`` word
boundaries, because those are ASCII-only in some engines and would mark
inside words such as ``Bäche``. Joining the pieces gives the text back, so
an excerpt without its markers equals the paragraph.

``mode='fragments'`` keeps the best fragments (``operators.fragments``), joined
with ``' ... '``; ``mode='full'`` keeps the whole paragraph. ``mode='windows'``
keeps a window of ``words`` tokens around every marked word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lexemes_of, marked_sql, pieces, sql_lexeme, sql_list
from .analysis import BoundQuery
from .fragments import with_fragments
from .matching import with_once

START_SEL = "**"
STOP_SEL = "**"
FRAGMENT_DELIMITER = " ... "
MAX_FRAGMENTS = 1000


def headline(text: str, q: BoundQuery) -> Column:
    """Full headline: the text column named ``text`` with query words marked."""
    return F.expr(marked_sql(text, q.config, q.lexemes, START_SEL, STOP_SEL))


def with_headline(df: DataFrame, text: str, q: BoundQuery, mode: str = "full",
                  words: int = 35, out: str = "h", max_fragments: int = MAX_FRAGMENTS,
                  only_matches: bool = False, phrase: bool = True) -> DataFrame:
    """Add the excerpt column ``out`` for text column ``text``.

    ``full``: the whole text, query words marked. ``fragments``: the best
    fragments of at most ``words`` words; ``phrase`` tells whether the query is
    a phrase or all its words. ``windows``: a piece is kept when a marked word
    lies within ``words/2`` words of it; runs of kept pieces are joined. At most
    ``max_fragments`` pieces of either kind. ``only_matches``: mark only words
    that belong to a phrase occurrence, else every word whose lexeme is a query
    lexeme.

    Each intermediate array (pieces, hit flags, keep flags) is materialised
    once per row, so every step is one pass over the paragraph (times the
    window for ``windows``).
    """
    if mode not in ("full", "fragments", "windows"):
        raise ValueError(f"unknown headline mode {mode!r}")
    if mode == "fragments":
        return with_fragments(df, text, q, phrase, out, words, max_fragments=max_fragments, only_matches=only_matches,
                              start_sel=START_SEL, stop_sel=STOP_SEL, delimiter=FRAGMENT_DELIMITER)
    if not q.lexemes:
        return df.withColumn(out, F.col(text))
    if mode == "full" and not only_matches:
        return df.withColumn(out, headline(text, q))
    word = F.lit(r"^[\p{L}\p{N}]")
    d = with_once(df, _ps=pieces(F.col(text)))
    if only_matches:
        d = with_once(d, _lx=lexemes_of(text, q.config))

        def at(i):
            cond = None
            for lx, off in q.terms:
                c = F.get(F.col("_lx"), i + off) == F.lit(lx)
                cond = c if cond is None else cond & c
            return F.coalesce(cond, F.lit(False))

        offs = sorted({o for _, o in q.terms})
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_lx") - F.lit(q.span), F.lit(0))), at)
        d = with_once(d, _mpos=F.flatten(F.transform(starts, lambda st: F.array(*[st + o for o in offs]))),
                      _w0=F.when(F.regexp_like(F.get(F.col("_ps"), 0), word), 0).otherwise(1))
        d = with_once(d, _hit=F.transform("_ps", lambda x, i: F.regexp_like(x, word) & F.array_contains(
            F.col("_mpos"), ((i - F.col("_w0")) / 2).cast("int"))))
    else:
        hit = f"coalesce({sql_lexeme('x', q.config)} IN {sql_list(q.lexemes)}, false)"
        d = with_once(d, _hit=F.expr(f"transform(_ps, x -> {hit})"))

    def mark(x, i):
        return F.when(F.get(F.col("_hit"), i), F.concat(F.lit(START_SEL), x, F.lit(STOP_SEL))).otherwise(x)

    if mode == "full":
        body = F.array_join(F.transform("_ps", mark), "")
        return d.withColumn(out, body).drop(*[c for c in ("_ps", "_lx", "_mpos", "_w0", "_hit") if c in d.columns])

    w = 2 * (words // 2)  # pieces alternate word / gap: words -> pieces
    d = with_once(d, _near=F.transform("_hit", lambda _x, i: F.exists(
        F.slice("_hit", F.greatest(i - w, F.lit(0)) + 1, i + w - F.greatest(i - w, F.lit(0)) + 1),
        lambda y: y)))

    def keep(x, i):
        near = F.coalesce(F.get(F.col("_near"), i), F.lit(False))
        prev = F.coalesce(F.get(F.col("_near"), i - 1), F.lit(False))
        nxt = F.coalesce(F.get(F.col("_near"), i + 1), F.lit(False))
        return near & (F.regexp_like(x, word) | (prev & nxt))

    d = with_once(d, _keep=F.transform("_ps", keep))
    # pieces from the start of fragment number max_fragments + 1 on are cut
    idx = F.sequence(F.lit(0), F.greatest(F.size("_ps") - 1, F.lit(0)))
    run_starts = F.filter(idx, lambda i: F.coalesce(F.get(F.col("_keep"), i), F.lit(False))
                          & ~F.coalesce(F.get(F.col("_keep"), i - 1), F.lit(False)))
    d = with_once(d, _cut=F.coalesce(F.get(run_starts, F.lit(max_fragments)), F.size("_ps")))

    def piece_out(x, i):
        kept = F.get(F.col("_keep"), i) & (i < F.col("_cut"))
        prev = F.coalesce(F.get(F.col("_keep"), i - 1), F.lit(False)) & (i - 1 < F.col("_cut"))
        # the first piece after a fragment carries the delimiter
        return F.when(kept, mark(x, i)).when(prev, F.lit(FRAGMENT_DELIMITER)).otherwise(F.lit(""))

    joined = F.array_join(F.transform("_ps", piece_out), "")
    body = F.trim(F.regexp_replace(joined, r"\Q" + FRAGMENT_DELIMITER + r"\E$", ""))
    tmp = ("_ps", "_lx", "_mpos", "_w0", "_hit", "_near", "_keep", "_cut")
    return d.withColumn(out, body).drop(*[c for c in tmp if c in d.columns])
