"""SQL building blocks for the DuckDB oracle queries.

Each registered Spark query has an oracle in plain SQL over the same
Parquet views. The oracles follow the *relational* definitions (unnest
tokens with positions, join the query terms, group by start position),
while the Spark side often uses a different physical form (array functions
per paragraph, k-gram windows, rarest-term anchors); agreement of both is
the check. One piece is shared on purpose: the analyser's lexeme expression
(stopword test + stemmer) is the same SQL text in both engines, since it is
the definition itself.
"""

from __future__ import annotations

from ..functions.stemming import stem_sql
from ..functions.text import (LANGUAGE_CONFIGS, PIECE_PATTERN, WORD_PATTERN, TextConfig, config,
                              sql_language_config, sql_lexeme,
                              sql_lexeme_by_language, sql_str, words_config)
from ..sources.tables import LANGUAGE_NAMES, NO_AUTHOR_SOURCE

NL = "chr(10)"


def _lang_name(code: str) -> str:
    whens = " ".join(f"WHEN {code} = {sql_str(c)} THEN {sql_str(n)}" for c, n in LANGUAGE_NAMES)
    return f"CASE {whens} ELSE {code} END"


BOOKS = f"""books AS (
  SELECT doc_id AS num,
         CASE WHEN source = {sql_str(NO_AUTHOR_SOURCE)} THEN NULL ELSE source END AS author,
         {_lang_name('lang')} AS language,
         'Document ' || CAST(doc_id AS VARCHAR) AS title,
         n_chars AS length,
         text AS content
  FROM documents)"""

def paragraphs_cte(catalogue=LANGUAGE_CONFIGS) -> str:
    return f"""paragraphs AS (
  SELECT num, language,
         CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS para,
         unnest(parts) AS paragraph
  FROM (SELECT num, {sql_language_config('language', catalogue)} AS language,
               string_split(content, '.' || {NL}) AS parts
        FROM books WHERE content IS NOT NULL AND length(content) > 0))"""


PARAGRAPHS = paragraphs_cte()


def tokens_cte(name: str, source: str, keys: str = "num, para, language",
               text: str = "paragraph") -> str:
    return f"""{name} AS (
  SELECT {keys}, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS ti, unnest(t) AS token
  FROM (SELECT {keys}, regexp_extract_all({text}, {sql_str(WORD_PATTERN)}) AS t FROM {source}))"""


def lexemes_cte(name: str, tokens: str, catalogue=LANGUAGE_CONFIGS) -> str:
    return f"""{name} AS (
  SELECT language, num, para, ti, lexeme FROM (
    SELECT language, num, para, ti, {sql_lexeme_by_language('token', 'language', catalogue)} AS lexeme
    FROM {tokens} WHERE language IS NOT NULL) WHERE lexeme IS NOT NULL)"""


def query_ctes(text: str, cfg: TextConfig | str, prefix: str = "q") -> str:
    """``{p}terms(lexeme, off)``, ``{p}n(n, span)``, ``{p}tl(tl)`` for one query."""
    cfg = config(cfg) if isinstance(cfg, str) else cfg
    p = prefix
    return f"""{p}tok AS (
  SELECT CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token
  FROM (SELECT regexp_extract_all({sql_str(text)}, {sql_str(WORD_PATTERN)}) AS t)),
{p}lex AS (SELECT pos, {sql_lexeme('token', cfg)} AS lexeme FROM {p}tok),
{p}terms AS (
  SELECT lexeme, pos - (SELECT min(pos) FROM {p}lex WHERE lexeme IS NOT NULL) AS off
  FROM {p}lex WHERE lexeme IS NOT NULL),
{p}n AS (SELECT count(DISTINCT off) AS n, max(off) + 1 AS span FROM {p}terms),
{p}tl AS (SELECT list(DISTINCT lexeme) AS tl FROM {p}terms)"""


def mark_sql(text: str, cfg: TextConfig | str, tl: str) -> str:
    """Full headline: words whose lexeme is in list ``tl`` wrapped in ``**``."""
    cfg = config(cfg) if isinstance(cfg, str) else cfg
    lx = sql_lexeme("x", cfg)
    return (f"array_to_string(list_transform(regexp_extract_all({text}, {sql_str(PIECE_PATTERN)}), "
            f"lambda x: CASE WHEN list_contains({tl}, {lx}) THEN '**' || x || '**' ELSE x END), '')")


SEP = f"{NL} || '[...]' || {NL}"


def rollup_sql(source: str, with_rank: bool, link_base: str) -> str:
    rank = ", round(avg(m.rank) * 100, 4) AS rank" if with_rank else ""
    return f"""SELECT b.author,
       '[' || b.title || '](' || {sql_str(link_base)} || CAST(b.num AS VARCHAR) || ')' AS title,
       b.num,
       '  ...' || substr(string_agg(DISTINCT m.h, {SEP} ORDER BY m.h), 1, 10000) || '...  '
         AS relevant_paragraphs{rank}
FROM {source} m JOIN books b ON m.num = b.num
GROUP BY b.author, b.title, b.num"""


def phrase_matches_sql(text: str, language: str) -> str:
    """CTEs ending in ``pm(num, para, n_matches, rank, h)``."""
    return f"""{query_ctes(text, language)},
lp AS (SELECT * FROM paragraphs WHERE language = {sql_str(language)}),
{tokens_cte('lt', 'lp')},
ll AS (SELECT num, para, ti, {sql_lexeme('token', language)} AS lexeme FROM lt),
starts AS (
  SELECT ll.num, ll.para, ll.ti - t.off AS st
  FROM ll JOIN qterms t ON ll.lexeme = t.lexeme
  GROUP BY ll.num, ll.para, ll.ti - t.off
  HAVING count(DISTINCT t.off) = (SELECT n FROM qn)),
mp AS (SELECT num, para, count(*) AS n_matches FROM starts GROUP BY num, para),
pm AS (
  SELECT mp.num, mp.para, mp.n_matches,
         (mp.n_matches * 0.1 / (1 + qn.span - qn.n)) / (mp.n_matches * 0.1 / (1 + qn.span - qn.n) + 1) AS rank,
         {mark_sql('lp.paragraph', language, 'qtl.tl')} AS h
  FROM mp JOIN lp ON mp.num = lp.num AND mp.para = lp.para, qn, qtl)"""


def all_words_sql(text: str, language: str) -> str:
    """CTEs ending in ``aw(num, para, h)``."""
    return f"""{query_ctes(text, language)},
lp AS (SELECT * FROM paragraphs WHERE language = {sql_str(language)}),
{tokens_cte('lt', 'lp')},
ll AS (SELECT num, para, ti, {sql_lexeme('token', language)} AS lexeme FROM lt),
awp AS (
  SELECT ll.num, ll.para FROM ll JOIN qterms t ON ll.lexeme = t.lexeme
  GROUP BY ll.num, ll.para
  HAVING count(DISTINCT ll.lexeme) = (SELECT count(DISTINCT lexeme) FROM qterms)),
aw AS (
  SELECT awp.num, awp.para, {mark_sql('lp.paragraph', language, 'qtl.tl')} AS h
  FROM awp JOIN lp ON awp.num = lp.num AND awp.para = lp.para, qtl)"""


def vocabulary_cte(tokens: str, catalogue=LANGUAGE_CONFIGS) -> str:
    """CTEs ``words`` (a row a token, no stopwords) and ``dict(language, word, lexeme, occurrences)``."""
    lx = sql_lexeme_by_language("token", "language", catalogue, stem=False)
    stems = " UNION ALL ".join(stem_sql(f"(SELECT * FROM vocab WHERE language = {sql_str(n)})", n) for n in catalogue)
    return f"""words AS (
  SELECT language, num, para, ti, word FROM (
    SELECT language, num, para, ti, {lx} AS word FROM {tokens} WHERE language IS NOT NULL) WHERE word IS NOT NULL),
vocab AS (SELECT language, word, count(*) AS occurrences FROM words GROUP BY language, word),
dict AS (SELECT language, word, lexeme, occurrences FROM ({stems}))"""


def stemmed_matches_sql(text: str, language: str) -> str:
    """CTEs ending in ``pm(num, para, rank, h)``: a phrase by stems, after ``vocabulary_cte``."""
    lx = sql_lexeme("token", words_config(language))
    return f"""qtok AS (
  SELECT CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token
  FROM (SELECT regexp_extract_all({sql_str(text)}, {sql_str(WORD_PATTERN)}) AS t)),
qwords AS (SELECT pos, word FROM (SELECT pos, {lx} AS word FROM qtok) WHERE word IS NOT NULL),
qterms AS (SELECT lexeme, pos - (SELECT min(pos) FROM qwords) AS off FROM ({stem_sql('qwords', language)})),
qn AS (SELECT count(DISTINCT off) AS n, max(off) + 1 AS span FROM qterms),
qforms AS (SELECT list(word) AS forms FROM dict WHERE language = {sql_str(language)} AND lexeme IN (SELECT lexeme FROM qterms)),
mp AS (
  SELECT num, para, count(*) AS n_matches FROM (
    SELECT w.num, w.para, w.ti - t.off AS st
    FROM words w JOIN dict d ON d.language = w.language AND d.word = w.word JOIN qterms t ON t.lexeme = d.lexeme
    WHERE w.language = {sql_str(language)}
    GROUP BY w.num, w.para, w.ti - t.off HAVING count(DISTINCT t.off) = (SELECT n FROM qn)) GROUP BY num, para),
pm AS (
  SELECT mp.num, mp.para, (n_matches * 0.1 / (1 + span - n)) / (n_matches * 0.1 / (1 + span - n) + 1) AS rank,
         array_to_string(list_transform(regexp_extract_all(p.paragraph, {sql_str(PIECE_PATTERN)}),
           lambda x: CASE WHEN list_contains(forms, lower(x)) THEN '**' || x || '**' ELSE x END), '') AS h
  FROM mp JOIN paragraphs p ON p.num = mp.num AND p.para = mp.para, qn, qforms)"""


def covers_sql(text: str, language: str, phrase: bool, p: str = "") -> str:
    """CTEs ending in ``{p}cov(num, para, s, e, n)`` and ``{p}hl(num, para, hs)``.

    A phrase's covers come from its start positions; those of an all-words
    query from a self join: for every hit the latest hit of each lexeme up to
    it, the least of which must have moved.
    """
    if phrase:
        found = f"""{p}st AS (
  SELECT h.num, h.para, h.ti - t.off AS s
  FROM {p}hits h JOIN {p}qterms t ON h.lexeme = t.lexeme
  GROUP BY h.num, h.para, h.ti - t.off HAVING count(*) = (SELECT n FROM {p}qn)),
{p}cov AS (
  SELECT st.num, st.para, st.s, st.s + span - 1 AS e, count(*) AS n
  FROM {p}st st JOIN {p}hits h ON h.num = st.num AND h.para = st.para, {p}qn
  WHERE h.ti BETWEEN st.s AND st.s + span - 1 GROUP BY st.num, st.para, st.s, span)"""
    else:
        found = f"""{p}lat AS (
  SELECT a.num, a.para, a.ti AS e, b.lexeme, max(b.ti) AS l
  FROM {p}hits a JOIN {p}hits b ON a.num = b.num AND a.para = b.para AND b.ti <= a.ti
  GROUP BY a.num, a.para, a.ti, b.lexeme),
{p}lef AS (
  SELECT num, para, e, CASE WHEN count(*) = (SELECT count(DISTINCT lexeme) FROM {p}qterms) THEN min(l) END AS s
  FROM {p}lat GROUP BY num, para, e),
{p}mov AS (SELECT *, lag(s) OVER (PARTITION BY num, para ORDER BY e) AS before FROM {p}lef),
{p}cov AS (
  SELECT m.num, m.para, m.s, m.e, count(*) AS n
  FROM {p}mov m JOIN {p}hits h ON h.num = m.num AND h.para = m.para AND h.ti BETWEEN m.s AND m.e
  WHERE m.s IS NOT NULL AND (m.before IS NULL OR m.s > m.before) GROUP BY m.num, m.para, m.s, m.e)"""
    return f"""{query_ctes(text, language, p + 'q')},
{p}lp AS (SELECT * FROM paragraphs WHERE language = {sql_str(language)}),
{tokens_cte(p + 'lt', p + 'lp')},
{p}hits AS (
  SELECT num, para, ti, lexeme FROM (SELECT num, para, ti, {sql_lexeme('token', language)} AS lexeme FROM {p}lt)
  WHERE lexeme IN (SELECT lexeme FROM {p}qterms)),
{found},
{p}hl AS (SELECT num, para, list(ti ORDER BY ti) AS hs FROM {p}hits GROUP BY num, para)"""


def fragments_sql(words: int = 35, short_word: int = 3, most: int = 1000, p: str = "") -> str:
    """CTEs ending in ``{p}frag(num, para, h)`` after ``covers_sql`` (recursive)."""
    return f"""{p}cut(num, para, last, a, b) AS (
  SELECT c.num, c.para, c.e, c.s, list_max(list_filter(hs, lambda x: x <= least(c.e, c.s + {words - 1})))
  FROM {p}cov c JOIN {p}hl USING (num, para)
  UNION ALL
  SELECT num, para, last, a2, list_max(list_filter(hs, lambda x: x <= least(last, a2 + {words - 1})))
  FROM (SELECT num, para, last, hs, list_min(list_filter(hs, lambda x: x > b AND x <= last)) AS a2
        FROM {p}cut JOIN {p}hl USING (num, para) WHERE b < last) WHERE a2 IS NOT NULL),
{p}cand AS (
  SELECT *, row_number() OVER (PARTITION BY num, para ORDER BY n DESC, b - a, a) AS j
  FROM (SELECT DISTINCT num, para, a, b, len(list_filter(hs, lambda x: x BETWEEN a AND b)) AS n
        FROM {p}cut JOIN {p}hl USING (num, para))),
{p}doc AS (
  SELECT num, para, hs, regexp_extract_all(paragraph, {sql_str(PIECE_PATTERN)}) AS ps,
         list_transform(regexp_extract_all(paragraph, {sql_str(WORD_PATTERN)}), lambda x: length(x)) AS wl
  FROM {p}lp JOIN {p}hl USING (num, para)),
{p}pick(num, para, j, got) AS (
  SELECT DISTINCT num, para, CAST(0 AS BIGINT), CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) FROM {p}cand
  UNION ALL
  SELECT num, para, j, CASE WHEN taken THEN got ELSE list_append(got, struct_pack(s := CAST(s AS BIGINT), e := CAST(
      list_max(list_filter(range(b, greatest(b, least(s + {words - 1}, right_)) + 1), lambda i: i = b OR wl[i + 1] > {short_word})) AS BIGINT))) END
  FROM (SELECT *, list_min(list_filter(range(greatest(a - greatest({words - 1} - b + a, 0) // 2, left_), a + 1),
                                       lambda i: i = a OR wl[i + 1] > {short_word})) AS s
        FROM (SELECT c.num, c.para, c.j, c.a, c.b, g.got, d.wl,
                     len(g.got) >= {most} OR len(list_filter(g.got, lambda x: x.s <= c.b AND c.a <= x.e)) > 0 AS taken,
                     coalesce(list_max(list_transform(list_filter(g.got, lambda x: x.e < c.a), lambda x: x.e)) + 1, 0) AS left_,
                     coalesce(list_min(list_transform(list_filter(g.got, lambda x: x.s > c.b), lambda x: x.s)) - 1, len(d.wl) - 1) AS right_
              FROM {p}pick g JOIN {p}cand c ON c.num = g.num AND c.para = g.para AND c.j = g.j + 1
              JOIN {p}doc d ON d.num = g.num AND d.para = g.para))),
{p}fin AS (SELECT num, para, list_sort(arg_max(got, j)) AS got FROM {p}pick GROUP BY num, para),
{p}frag AS (
  SELECT num, para, array_to_string(list_transform(got, lambda f: array_to_string(list_transform(range(w0 + 2 * f.s, w0 + 2 * f.e + 1),
      lambda i: CASE WHEN (i - w0) % 2 = 0 AND list_contains(hs, (i - w0) // 2) THEN '**' || ps[i + 1] || '**' ELSE ps[i + 1] END), '')), ' ... ') AS h
  FROM (SELECT f.num, f.para, f.got, d.hs, d.ps, CASE WHEN regexp_matches(d.ps[1], '^[\\p{{L}}\\p{{N}}]') THEN 0 ELSE 1 END AS w0
        FROM {p}fin f JOIN {p}doc d USING (num, para)))"""


def covers_rank_sql(cov: str) -> str:
    """``num, para, covers, rank`` of the covers of one query."""
    return f"""SELECT num, para, count(*) AS covers, round(sum(0.1 / (2 + e - s - n)) / (sum(0.1 / (2 + e - s - n)) + 1), 8) AS rank
FROM {cov} GROUP BY num, para"""


def with_ctes(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


__all__ = ["BOOKS", "PARAGRAPHS", "tokens_cte", "lexemes_cte",
           "query_ctes", "mark_sql", "rollup_sql", "phrase_matches_sql",
           "all_words_sql", "covers_sql", "fragments_sql", "covers_rank_sql", "vocabulary_cte",
           "stemmed_matches_sql", "with_ctes"]
