"""Cover-density rank (Clarke, Cormack & Tudhope, 2000).

Our definition, after the reference's ``ts_rank_cd(vector, query, 32)``:
every cover (``operators.covers``) weighs ``0.1 / (1 + noise)`` where ``noise``
is the number of positions inside the cover that hold no query lexeme. ``W``
sums the covers of the paragraph and the rank is scaled to ``W / (W + 1)``.

``covers_rank`` looks at the covers themselves. ``cover_density_rank`` takes the
noise of a phrase to be its gaps, ``span - number of terms``; the two differ
only where a gap of the phrase (a stopword's place) holds another query word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .analysis import BoundQuery

# Fixed value: weight of a term of the default class.
TERM_WEIGHT = 0.1


def cover_weight(q: BoundQuery) -> float:
    noise = q.span - q.size
    return TERM_WEIGHT / (1 + noise)


def cover_density_rank(n_matches: Column, q: BoundQuery) -> Column:
    w = n_matches.cast("double") * F.lit(cover_weight(q))
    return w / (w + F.lit(1.0))


def covers_rank(covers: str = "covers") -> Column:
    """Rank from the array column ``covers`` of ``(s, e, n)``; 0 without covers."""
    w = F.aggregate(covers, F.lit(0.0), lambda acc, c: acc + F.lit(TERM_WEIGHT) / (
        F.lit(2) + c["e"] - c["s"] - c["n"]).cast("double"))
    return w / (w + F.lit(1.0))
