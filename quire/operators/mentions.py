"""Which names are mentioned in whose books: the text join, as an equi-join.

The reference joins every candidate name to every paragraph with a full-text
match predicate (a theta join). Here a name is its row of lowercased tokens (the
``simple`` analyser), and the text is read once. A paragraph's positions walk
down a trie of the names' words that is kept as bits of hashes: the first word,
the first ``min(k, 4)`` words of a name of ``k``, and the whole run for each
length that occurs among the names. What gets through in the paragraph's own
arrays is nearly always a mention; only these runs leave the row and meet the
names in an equi-join on the words themselves, so hashes decide nothing.

The bits have a fixed size (``BITS`` a level, gathered from the names by one
aggregation) and are a constant of the plan. With very many names they fill up
and let more runs through to the join; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LANGUAGE_CONFIGS, tokens
from .analysis import query_terms
from .matching import numbered, phrase_match_postings, phrase_starts_rare_first, with_once

# Author names the reference excludes from mention matching.
EXCLUDED_NAMES = (
    "Various", "Unknown", "Anonymous", "Jr.", "L.", "Peer", "Dom", "British Museum",
    "Clara", "Morgan", "Duchess", "Baker", "Elizabeth", "Hale", "R. H.", "G. W.",
    "W. B.", "W. M.", "Wang", "Wu", "V. M.", "F.R.G.S.",
)

# Bits of the trie's first level and of each other level, and the words of its
# deepest prefix.
FIRSTS = 1 << 16
BITS = 1 << 18
PREFIX = 4


def simple_tokens(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.lower(t))


def distinct_count(df: DataFrame, keys, counted: str, alias: str) -> DataFrame:
    """``count(DISTINCT counted)`` per ``keys``, skew-safe.

    De-duplicating on (keys, counted) shuffles on both, so one key holding a
    third of all rows is spread over many tasks; the per-key count is then a
    partial (map-side) aggregate. A plain distinct aggregate would send all
    distinct values of a hot key to one task.
    """
    keys = list(keys)
    return (df.select(*keys, counted).distinct()
            .groupBy(*keys).agg(F.count("*").alias(alias)))


def mention_candidates(books: DataFrame, excluded=EXCLUDED_NAMES) -> DataFrame:
    """``author, books``: authors to look for, with their number of books."""
    named = books.where(F.col("author").isNotNull() & ~F.col("author").isin(list(excluded)))
    return distinct_count(named, ["author"], "num", "books")


def author_book_counts(books: DataFrame) -> DataFrame:
    """``author, books``: distinct books per (non-NULL) author."""
    return distinct_count(books.where(F.col("author").isNotNull()), ["author"], "num", "books")


def name_keys(names: DataFrame, name_col: str = "name") -> DataFrame:
    """``name, k, key`` for every distinct name with at least one token; ``key``
    are its tokens with spaces between (a token has none)."""
    toks = simple_tokens(F.col(name_col))
    g = with_once(names.select(F.col(name_col).alias("name")).distinct(), toks=toks).where(F.size("toks") > 0)
    return g.select("name", F.size("toks").alias("k"), F.array_join("toks", " ").alias("key"), "toks")


def _hash(words: int) -> str:
    """SQL: hash of the next ``words`` words of ``toks`` from 0-based ``i`` on."""
    return f"xxhash64({', '.join(f'toks[i + {j}]' if j else 'toks[i]' for j in range(words))})"


def _bit(level: int, at: str) -> str:
    """SQL: whether bit ``at`` (from 0) of a level of the trie is set."""
    return f"shiftright(element_at({{{level}}}, int(shiftright({at}, 6)) + 1), int({at} & 63)) & 1 = 1"


def name_trie(keys: DataFrame) -> tuple[list[str], list[int]]:
    """The levels as SQL constants ('' for an empty one), and the lengths of the names.

    One row a filled word of bits comes to the driver, ``BITS / 64`` a level at
    most, and one a length. Levels: 0 first words (an array of booleans, tested
    for every word of the text), 1 to ``PREFIX`` the first words of names with so
    many or (the last) more, then whole names (bits of longs).
    """
    prefix = " ".join(f"WHEN {m} THEN {_hash(m)}" for m in range(1, PREFIX + 1)).replace("toks[i + ", "toks[").replace("toks[i]", "toks[0]")
    marks = (("0", f"pmod(xxhash64(toks[0]), {FIRSTS}L)"), (f"least(k, {PREFIX})", f"pmod(CASE least(k, {PREFIX}) {prefix} END, {{b}})"),
             (f"{PREFIX + 1}", "pmod(xxhash64(key), {b})"), (f"{PREFIX + 2}", "64L * k"))
    structs = ", ".join(f"named_struct('level', {level}, 'at', {at})" for level, at in marks).replace("{b}", f"{BITS}L")
    words = (keys.select(F.expr(f"inline(array({structs}))"))
             .groupBy("level", F.expr("int(shiftright(at, 6))").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")))
    held = [[0] * (BITS // 64) for _ in range(PREFIX + 2)]
    sizes = []
    for r in words.collect():
        if r["level"] == PREFIX + 2:
            sizes.append(r["word"])
        else:
            held[r["level"]][r["word"]] = r["bits"]
    firsts = ",".join(str(held[0][i >> 6] >> (i & 63) & 1) for i in range(FIRSTS))
    levels = [f"cast(split('{','.join(map(str, h))}', ',') AS array<bigint>)" if any(h) else "" for h in held[1:]]
    return [f"cast(split('{firsts}', ',') AS array<boolean>)", *levels], sorted(sizes)


def text_runs(paragraphs: DataFrame, trie: list[str], lengths: list[int]) -> DataFrame:
    """``num, key``: runs of words of each paragraph that pass the trie's bits."""
    p = with_once(paragraphs.select("num", "paragraph"), toks=simple_tokens(F.col("paragraph")))
    starts = f"filter(transform(toks, (x, i) -> IF({{0}}[int(pmod(xxhash64(x), {FIRSTS}L))], i, -1)), i -> i >= 0)"
    deeper = " OR ".join(f"(i + {m} <= size(toks) AND ({_bit(m, f'pmod({_hash(m)}, {BITS}L)')}))"
                         for m in range(1, PREFIX + 1) if trie[m])
    runs = (f"filter(transform(filter(array({', '.join(map(str, lengths))}), k -> i + k <= size(toks)), "
            f"k -> array_join(slice(toks, i + 1, k), ' ')), r -> {_bit(PREFIX + 1, f'pmod(xxhash64(r), {BITS}L)')})")
    found = f"array_distinct(flatten(transform(filter({starts}, i -> {deeper}), i -> {runs})))".format(*trie)
    return p.select("num", F.explode(F.expr(found)).alias("key"))


def name_hits(names: DataFrame, paragraphs: DataFrame, name_col: str = "name") -> DataFrame:
    """``name, num``: distinct books whose text has the name's words in a row."""
    keys = name_keys(names, name_col)
    trie, lengths = name_trie(keys)
    if not lengths:
        return keys.select("name", F.lit(None).cast(paragraphs.schema["num"].dataType).alias("num")).where(F.lit(False))
    runs = text_runs(paragraphs, trie, lengths).distinct()
    return runs.join(keys.select("name", "key"), "key").select("name", "num")


def mention_pairs(names: DataFrame, paragraphs: DataFrame, books: DataFrame,
                  name_col: str = "name", excluded=()) -> DataFrame:
    """``mentioned_author, mentioned_by, books_mentioned_in``, most books first.

    ``names``: the names to look for, less the ``excluded`` ones;
    ``paragraphs``: ``num, para, paragraph``; ``books``: ``num, author``. A
    mention counts once per book (``count(distinct num)``); books without
    author are left out, as are names of no token. Self-mentions are kept, as
    in the reference.
    """
    if excluded:
        names = names.where(~F.col(name_col).isin(list(excluded)))
    return _pairs_by_author(name_hits(names, paragraphs, name_col), books)


def _pairs_by_author(hits: DataFrame, books: DataFrame) -> DataFrame:
    """(name, num) hits -> ``mentioned_author, mentioned_by, books_mentioned_in``."""
    by = books.where(F.col("author").isNotNull()).select("num", F.col("author").alias("mentioned_by"))
    pairs = hits.join(by, "num").select(F.col("name").alias("mentioned_author"), "mentioned_by", "num")
    counted = distinct_count(pairs, ["mentioned_author", "mentioned_by"], "num", "books_mentioned_in")
    return _most_first(counted)


def _most_first(counted: DataFrame) -> DataFrame:
    return counted.orderBy(F.col("books_mentioned_in").desc(), "mentioned_author", "mentioned_by")


def mention_pairs_postings(names: DataFrame, analyzed: DataFrame, books: DataFrame,
                           name_config: str | None = None, name_col: str = "name",
                           rare_first: bool = True, freq: DataFrame | None = None,
                           catalogue=LANGUAGE_CONFIGS) -> DataFrame:
    """Mention pairs over analysed paragraphs: each name is a phrase query.

    ``analyzed``: positional lexemes ``language, num, para, ti, lexeme`` (the
    paragraphs' own analysers) or the stored postings (``positions`` arrays);
    ``freq`` (``language, lexeme, n``), e.g. from ``lexeme_stats``, saves the
    frequency pass. ``name_config=None`` analyses each name with
    the analyser of the paragraphs it is matched against (stopwords leave
    gaps, as in the text); ``name_config='simple'`` is the reference's mixed
    mode, where a name word that the paragraph analyser drops or stems can
    never match. With ``rare_first`` each name is anchored on its rarest word,
    so a common word in many names never joins all of its postings to all of
    those names. The names found are gathered per book before the books'
    authors are joined, so a mention is shuffled once, as the name's number.
    """
    spark = names.sparkSession
    ids = numbered(names.select(F.col(name_col).alias("query")).distinct(), "query_id", "names")
    terms = None
    for lang in catalogue:
        t = query_terms(spark, ids, name_config or lang).withColumn("language", F.lit(lang))
        terms = t if terms is None else terms.unionByName(t)
    find = phrase_starts_rare_first if rare_first else phrase_match_postings
    hits = find(analyzed, terms, *([freq] if rare_first else []), on=("language", "lexeme"))
    found = hits.groupBy("num").agg(F.collect_set("query_id").alias("found"))
    by = books.where(F.col("author").isNotNull()).select("num", F.col("author").alias("mentioned_by")).distinct()
    pairs = found.join(by, "num").select(F.explode("found").alias("query_id"), "mentioned_by")
    counted = pairs.groupBy("query_id", "mentioned_by").agg(F.count("*").alias("books_mentioned_in")).join(ids, "query_id")
    return _most_first(counted.select(F.col("query").alias("mentioned_author"), "mentioned_by", "books_mentioned_in"))


def mention_edges(pairs: DataFrame) -> DataFrame:
    """Undirected edges ``a <= b`` with the summed weight of both directions."""
    a = F.least("mentioned_author", "mentioned_by")
    b = F.greatest("mentioned_author", "mentioned_by")
    return (pairs.groupBy(a.alias("a"), b.alias("b"))
            .agg(F.sum("books_mentioned_in").alias("books_mentioned_in")))
