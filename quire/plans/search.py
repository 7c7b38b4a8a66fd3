"""Search and discovery, end to end.

Search (phrase): match -> rank -> headline per paragraph, then a roll-up per
book: distinct excerpts sorted and joined (cut at 10,000 characters), the
average rank in percent, author and a title link; then order and page.

Discovery (all words): match -> headline -> the same roll-up, then 30 books in
a seeded pseudo-random order (``md5(seed:num)``: reproducible, independent of
partitioning, unlike ``rand()``).

Plan shape: the match runs over paragraphs first and only matched paragraphs
(not the books, not the text of other paragraphs) go through shuffles; the
book metadata is joined last, after aggregation, with ``content`` pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import spark_sql_str, title_link
from ..operators.analysis import BoundQuery, bind_query
from ..operators.headline import with_headline
from ..operators.matching import all_words_match, phrase_match
from ..operators.paragraphs import book_paragraphs
from ..operators.postings import PAIR_GAP, book_block, pair_key
from ..operators.ranking import cover_density_rank
from ..operators.vocabulary import bind_stemmed

# Fixed values of the result format.
EXCERPT_SEPARATOR = "\n[...]\n"
EXCERPT_LIMIT = 10000
EXCERPT_PREFIX = "  ..."
EXCERPT_SUFFIX = "...  "
DISCOVERY_ROWS = 30
# Base of the title links; a deployment passes its catalogue's book URL.
DEFAULT_LINK_BASE = "ebooks/"
# Salt buckets for the per-book excerpt selection (spreads one hot book).
EXCERPT_SALT = 64


def rollup_books(matched: DataFrame, books: DataFrame, link_base: str = DEFAULT_LINK_BASE,
                 with_rank: bool = True, salt: int = EXCERPT_SALT) -> DataFrame:
    """Per book: ``author, title, num, relevant_paragraphs[, rank]``.

    ``matched`` has one row per matched paragraph: ``num, h`` (its excerpt)
    and, for search, ``rank``. One pipeline, no branch re-reading the input:

    1. cut excerpts to the output length (keeps their order and the cut
       result) and aggregate by (num, h), combining on the map side: an excerpt
       repeated any number of times leaves a task once;
    2. inside (num, salt bucket) windows keep the excerpts that reach into the
       output length of the bucket's own sorted text (in the whole book's
       they start no earlier), carrying the bucket's rank totals on its first
       row: a bucket passes on at most two output lengths of text;
    3. the same per book over at most ``salt`` x two output lengths, then the
       sorted excerpts joined and the average rank = sum / count.
    """
    m = matched.withColumn("h", F.substring("h", 1, EXCERPT_LIMIT))
    rank = F.col("rank") if with_rank else F.lit(0.0)
    by_h = m.groupBy("num", "h").agg(F.sum(rank).alias("rs"), F.count("*").alias("rc"))
    salted = by_h.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(salt)))
    step = F.length("h") + len(EXCERPT_SEPARATOR)

    def begins(*keys):
        """Where an excerpt starts in the sorted, joined text of its group."""
        w = Window.partitionBy(*keys).orderBy("h")
        return F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - step

    # an excerpt counts if the separator before it starts within the text
    end = EXCERPT_LIMIT + len(EXCERPT_SEPARATOR)

    whole = Window.partitionBy("num", "bucket")
    first = (salted.select("num", "h", begins("num", "bucket").alias("b1"),
                           F.sum("rs").over(whole).alias("brs"), F.sum("rc").over(whole).alias("brc"))
             .where(F.col("b1") < end))
    first = first.select("num", "h",
                         F.when(F.col("b1") == 0, F.col("brs")).otherwise(F.lit(0.0)).alias("brs"),
                         F.when(F.col("b1") == 0, F.col("brc")).otherwise(F.lit(0)).alias("brc"))
    per_book = (first.withColumn("b2", begins("num"))
                .groupBy("num")
                .agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("b2") < end, F.col("h")))),
                                  EXCERPT_SEPARATOR).alias("agg"),
                     (F.sum("brs") / F.sum("brc")).alias("avg_rank")))
    return _book_rows(per_book, books, link_base, with_rank)


def _book_rows(per_book: DataFrame, books: DataFrame, link_base: str, with_rank: bool) -> DataFrame:
    text = F.concat(F.lit(EXCERPT_PREFIX), F.substring("agg", 1, EXCERPT_LIMIT),
                    F.lit(EXCERPT_SUFFIX))
    meta = books.select("num", "author", "title")
    cols = [F.col("author"), title_link(F.col("title"), F.col("num"), link_base).alias("title"),
            F.col("num"), text.alias("relevant_paragraphs")]
    if with_rank:
        cols.append(F.round(F.col("avg_rank") * 100, 4).alias("rank"))
    return per_book.join(meta, "num").select(*cols)


def _language_paragraphs(books: DataFrame, cfg_name: str) -> DataFrame:
    return book_paragraphs(books).where(F.col("language") == cfg_name)


def _as_query(spark: SparkSession, query: str | BoundQuery, language: str, idx: dict | None = None) -> BoundQuery:
    if isinstance(query, BoundQuery):
        return query
    if idx and "dictionary" in idx:
        return bind_stemmed(spark, query, language, idx["dictionary"])
    return bind_query(spark, query, language)


def phrase_matches(spark: SparkSession, books: DataFrame, query: str | BoundQuery,
                   language: str = "english", paragraphs: DataFrame | None = None,
                   mode: str = "fragments", only_matches: bool = False) -> DataFrame:
    """``num, para, n_matches, rank, h`` for every matching paragraph.

    ``mode`` / ``only_matches``: see ``operators.headline.with_headline``.
    """
    q = _as_query(spark, query, language)
    paras = paragraphs if paragraphs is not None else _language_paragraphs(books, q.config.name)
    m = with_headline(phrase_match(paras, q), "paragraph", q, mode, only_matches=only_matches)
    return m.select("num", "para", "n_matches",
                    cover_density_rank(F.col("n_matches"), q).alias("rank"), "h")


def phrase_search(spark: SparkSession, books: DataFrame, query: str | BoundQuery,
                  language: str = "english", link_base: str = DEFAULT_LINK_BASE,
                  paragraphs: DataFrame | None = None, mode: str = "fragments",
                  only_matches: bool = False) -> DataFrame:
    """All matching books (unordered): author, title, num, relevant_paragraphs, rank."""
    m = phrase_matches(spark, books, query, language, paragraphs, mode, only_matches)
    return rollup_books(m, books, link_base, with_rank=True)


def page(result: DataFrame, limit: int = 10, start: int = 1) -> DataFrame:
    """Rows ``start .. start + limit - 1`` by rank (ties: smaller num first)."""
    if limit < 1 or start < 1:
        raise ValueError("limit and start are 1-based positive integers")
    ordered = result.orderBy(F.col("rank").desc_nulls_last(), F.col("num").asc())
    return ordered.offset(start - 1).limit(limit) if start > 1 else ordered.limit(limit)


def discovery_search(spark: SparkSession, books: DataFrame, query: str | BoundQuery,
                     language: str = "english", seed: int = 42, n: int = DISCOVERY_ROWS,
                     link_base: str = DEFAULT_LINK_BASE,
                     paragraphs: DataFrame | None = None, mode: str = "fragments") -> DataFrame:
    """``n`` books with all query words in one paragraph, seeded random order."""
    q = _as_query(spark, query, language)
    paras = paragraphs if paragraphs is not None else _language_paragraphs(books, q.config.name)
    m = with_headline(all_words_match(paras, q), "paragraph", q, mode, phrase=False).select("num", "h")
    res = rollup_books(m, books, link_base, with_rank=False)
    rand = seeded_random(F.col("num"), seed)
    return res.withColumn("rand", rand).orderBy("rand", "num").limit(n)


def seeded_random(num: Column, seed: int) -> Column:
    """Reproducible random sort key: ``md5('<seed>:<num>')``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), num.cast("string")))


# ------------------------------------------------------------ over the index
#
# Every function is one lazy plan: the query is bound as literals, and the
# positions of its words meet in one exchange on the paragraph, which the phrase
# test and the paragraph count reuse; only counts go on to the book. Text is read for
# matched paragraphs only, on a page for the page's books only.

def phrase_hits(postings: DataFrame, terms) -> DataFrame:
    """``num, para, n_matches`` from positions ``num, para, ti, lexeme``.

    ``terms`` are the lists read and their offsets (a query's terms, or pairs of
    them). An occurrence starts at ``ti - offset`` and is complete when all the
    lists have it; a position is once in a list, so rows are counted.
    """
    by = {}
    for key, off in terms:
        by.setdefault(key, []).append(str(off))
    offsets = " ".join(f"WHEN {spark_sql_str(key)} THEN array({', '.join(offs)})" for key, offs in sorted(by.items()))
    dealt = (postings.select("num", "para", "ti", F.explode(F.expr(f"CASE lexeme {offsets} END")).alias("off"))
             .select("num", "para", (F.col("ti") - F.col("off")).alias("start")).repartition("num", "para"))
    return (dealt.groupBy("num", "para", "start").count().where(F.col("count") == len(terms))
            .groupBy("num", "para").agg(F.count("*").alias("n_matches")))


def phrase_lists(q: BoundQuery, frequent) -> tuple[list, list]:
    """Which lists a phrase reads: pairs of neighbouring frequent terms, and the
    terms in no pair; each with its offset."""
    common, pairs, paired = set(frequent), [], set()
    for (a, i), (b, j) in zip(q.terms, q.terms[1:]):
        if a in common and b in common and j - i <= PAIR_GAP:
            pairs.append((pair_key(a, b, j - i), i))
            paired |= {i, j}
    return pairs, [t for t in q.terms if t[1] not in paired]


def all_words_hits(postings: DataFrame, q: BoundQuery) -> DataFrame:
    """``num, para`` where every query lexeme occurs; a paragraph's set of them
    is no larger than the query."""
    found = postings.groupBy("num", "para").agg(F.size(F.collect_set("lexeme")).alias("found"))
    return found.where(F.col("found") == len(q.lexemes)).select("num", "para")


def _no_hits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "num long, para int, n_matches long")


def index_hits(spark: SparkSession, idx: dict, q: BoundQuery, phrase: bool = True) -> DataFrame:
    """Matched paragraphs ``num, para`` (and ``n_matches`` of a phrase), from the lists alone."""
    if not q.terms:
        return _no_hits(spark)
    name = q.config.name
    if not phrase:
        return all_words_hits(idx["open"](name, q.lexemes), q)
    pairs, single = phrase_lists(q, idx.get("frequent", {}).get(name, ()))
    read = None
    for terms, table in ((pairs, "pairs"), (single, "postings")):
        if terms:
            rows = idx["open"](name, sorted({key for key, _ in terms}), table).select("num", "para", "ti", "lexeme")
            read = rows if read is None else read.unionByName(rows)
    return phrase_hits(read, pairs + single)


def _excerpts(idx: dict, hits: DataFrame, q: BoundQuery, mode: str, only_matches: bool) -> DataFrame:
    """Matched paragraphs with excerpt (and rank for a phrase).

    Hits are narrow; whether they are broadcast to the text or both are
    shuffled is the optimizer's choice by bytes.
    """
    paras = idx["paragraphs"].where(F.col("language") == q.config.name).select("num", "para", "paragraph", "block")
    where = hits.withColumn("block", book_block(F.col("num"), idx["blocks"]))
    m = with_headline(paras.join(where, ["block", "num", "para"]), "paragraph", q, mode, only_matches=only_matches,
                      phrase="n_matches" in hits.columns)
    if "n_matches" in hits.columns:
        return m.select("num", "para", "n_matches", cover_density_rank(F.col("n_matches"), q).alias("rank"), "h")
    return m.select("num", "para", "h")


def index_phrase_search(spark: SparkSession, idx: dict, books: DataFrame, query: str | BoundQuery,
                        language: str = "english", link_base: str = DEFAULT_LINK_BASE,
                        mode: str = "fragments", only_matches: bool = False) -> DataFrame:
    """``phrase_search`` over a stored index (``read_index``): all matching books."""
    q = _as_query(spark, query, language, idx)
    m = _excerpts(idx, index_hits(spark, idx, q, True), q, mode, only_matches)
    return rollup_books(m, books, link_base, with_rank=True)


def index_phrase_page(spark: SparkSession, idx: dict, books: DataFrame, query: str | BoundQuery,
                      language: str = "english", limit: int = 10, start: int = 1,
                      link_base: str = DEFAULT_LINK_BASE, mode: str = "fragments",
                      only_matches: bool = False) -> DataFrame:
    """One page of the search: rank from the postings alone, take the page,
    then read and mark the text of its books (at most ``limit`` book ids are
    broadcast to the paragraphs, which are pruned to the books' blocks)."""
    if limit < 1 or start < 1:
        raise ValueError("limit and start are 1-based positive integers")
    q = _as_query(spark, query, language, idx)
    hits = index_hits(spark, idx, q, True)
    rank = cover_density_rank(F.col("n_matches"), q)
    ranks = hits.groupBy("num").agg(F.round(F.sum(rank) / F.count("*") * 100, 4).alias("rank"))
    top = (ranks.join(books.select("num"), "num", "left_semi")
           .orderBy(F.col("rank").desc(), F.col("num")).offset(start - 1).limit(limit).select("num"))
    return page(_of_books(spark, idx, hits, top, books, q, link_base, mode, only_matches, True), limit)


def _of_books(spark, idx: dict, hits: DataFrame, top: DataFrame, books: DataFrame, q: BoundQuery,
              link_base: str, mode: str, only_matches: bool, with_rank: bool) -> DataFrame:
    """The result rows of the few books in ``top``."""
    chosen = F.broadcast(top.withColumn("block", book_block(F.col("num"), idx["blocks"])))
    near = idx | {"paragraphs": idx["paragraphs"].join(chosen, ["block", "num"])}
    m = _excerpts(near, hits.join(F.broadcast(top), "num"), q, mode, only_matches)
    return rollup_books(m, books, link_base, with_rank=with_rank)


def index_discovery_search(spark: SparkSession, idx: dict, books: DataFrame, query: str | BoundQuery,
                           language: str = "english", seed: int = 42, n: int = DISCOVERY_ROWS,
                           link_base: str = DEFAULT_LINK_BASE, mode: str = "fragments") -> DataFrame:
    """``discovery_search`` over a stored index: the ``n`` books are drawn from
    the hits, then only their text is read."""
    q = _as_query(spark, query, language, idx)
    hits = index_hits(spark, idx, q, False).select("num", "para")
    rand = seeded_random(F.col("num"), seed)
    top = (hits.select("num").distinct().join(books.select("num"), "num", "left_semi")
           .orderBy(rand, "num").limit(n))
    res = _of_books(spark, idx, hits, top, books, q, link_base, mode, False, False)
    return res.withColumn("rand", rand).orderBy("rand", "num").limit(n)
