"""Text analysis as Spark column expressions.

Definitions (ours; the reference delegates them to its database):

- token: a maximal run of letters or digits (``[\\p{L}\\p{N}]+``);
- position: index of the token in its paragraph, counted *before* stopwords
  are removed, so ``cat to dog`` puts ``dog`` two positions after ``cat``;
- lexeme: the lowercased token, NULL when it is a stopword of the analyser,
  then passed through the analyser's stemmer (if any).

Analysers (``TextConfig``): ``simple`` lowercases only; ``english`` drops
Spark's English stopwords and applies the S-stemmer (Harman 1991: ``-ies`` ->
``-y``, ``-es`` -> ``-e``, ``-s`` -> ``''`` with the usual exceptions);
the other languages drop Spark's stopwords for that language.

Every function here has a SQL twin (``sql_*``) used to write the DuckDB
oracle queries, so both engines evaluate the same definition.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import stopwords

WORD_PATTERN = r"[\p{L}\p{N}]+"
# words and the gaps between them, in order: concatenated they give the text back
PIECE_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class TextConfig:
    """An analyser. ``forms``, if given, are the only words with a lexeme,
    ``(word, lexeme)`` pairs: a query expanded by a dictionary."""
    name: str
    stop_language: str | None = None
    stemmer: str | None = None
    forms: tuple[tuple[str, str], ...] | None = None

    @property
    def stopwords(self) -> tuple[str, ...]:
        return stopwords(self.stop_language) if self.stop_language else ()


CONFIGS: dict[str, TextConfig] = {
    "simple": TextConfig("simple"),
    "english": TextConfig("english", "english", "s"),
} | {name: TextConfig(name, name) for name in (
    "danish", "dutch", "finnish", "french", "german", "hungarian", "italian", "norwegian",
    "portuguese", "russian", "spanish", "swedish", "turkish")}

# The analyser names a book language can map to (``lower(language) = cfgname``).
# 'simple' is only used explicitly (name matching), never for a book language.
# A catalogue is a tuple of names, passed wherever a language picks its analyser;
# this one is the default, ``ALL_LANGUAGES`` has every language Spark ships.
LANGUAGE_CONFIGS = ("english", "french", "german")
ALL_LANGUAGES = tuple(sorted(n for n in CONFIGS if n != "simple"))


def config(name: str) -> TextConfig:
    try:
        return CONFIGS[name]
    except KeyError:
        raise ValueError(f"unknown text configuration {name!r}") from None


def words_config(cfg: TextConfig | str) -> TextConfig:
    """The analyser without its stemmer: lower-cased words, stopwords dropped."""
    cfg = config(cfg) if isinstance(cfg, str) else cfg
    return replace(cfg, stemmer=None)


# ---------------------------------------------------------------- Spark side
#
# The analyser expressions are built from their SQL text (the same text the
# oracle uses) with one ``expr`` call each: building them literal by literal
# through the Python API costs hundreds of gateway calls per query plan.

def spark_sql_str(s: str) -> str:
    """A Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lexemes_of(text_sql: str, cfg: TextConfig | str, empty_for_stop: bool = True) -> Column:
    """Array of lexemes of the text column ``text_sql``, by position.

    Stopword positions hold '' (never a lexeme) when ``empty_for_stop``,
    else NULL.
    """
    lx = sql_lexeme("t", cfg)
    if empty_for_stop:
        lx = f"coalesce({lx}, '')"
    return F.expr(f"transform(regexp_extract_all({text_sql}, {spark_sql_str(WORD_PATTERN)}, 0), t -> {lx})")


def marked_sql(text_sql: str, cfg: TextConfig | str, lexemes, start: str, stop: str) -> str:
    """SQL: words of ``text_sql`` whose lexeme is in ``lexemes`` wrapped in markers."""
    lx = sql_lexeme("x", cfg)
    inlist = sql_list(lexemes) if lexemes else "(NULL)"
    return (f"array_join(transform(regexp_extract_all({text_sql}, {spark_sql_str(PIECE_PATTERN)}, 0), "
            f"x -> CASE WHEN {lx} IN {inlist} THEN concat({sql_str(start)}, x, {sql_str(stop)}) "
            f"ELSE x END), '')")


def tokens(text: Column) -> Column:
    """Array of tokens of ``text``, in order."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def pieces(text: Column) -> Column:
    """Array of alternating words and gaps; ``array_join(pieces, '')`` == text."""
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))


def s_stem(w: str) -> Column:
    """The S-stemmer on the (lowercased) word column named ``w``."""
    return F.expr(sql_s_stem(w))


def lexeme(token: str, cfg: TextConfig | str) -> Column:
    """Lexeme of the token column or lambda variable named ``token``; NULL for a stopword."""
    return F.expr(sql_lexeme(token, cfg))


def lexeme_by_language(token: str, language: str = "language", catalogue=LANGUAGE_CONFIGS,
                       stem: bool = True) -> Column:
    """Lexeme under the analyser named by column ``language`` (NULL if none)."""
    return F.expr(sql_lexeme_by_language(token, language, catalogue, stem))


def language_config(language: Column, catalogue=LANGUAGE_CONFIGS) -> Column:
    """``lower(language)`` when it names a supported analyser, else NULL.

    The reference joins books to its catalogue of analysers on
    ``lower(language) = cfgname``; the catalogue is a tiny list, so
    the join is an ``IN`` over literals (a hash set in generated code).
    """
    low = F.lower(language)
    return F.when(low.isin(list(catalogue)), low)


def sentinel_null(c: Column, sentinel: str = "?") -> Column:
    """The catalogue's unknown marker becomes NULL (whole-value match only)."""
    return F.nullif(c, F.lit(sentinel))


def title_link(title: Column, num: Column, base: str) -> Column:
    """Markdown link ``[title](base num)``; NULL when the title is NULL."""
    return F.concat(F.lit("["), title, F.lit("]("), F.lit(base),
                    num.cast("string"), F.lit(")"))


def rank_text(rank_percent: Column) -> Column:
    """Rank as text with one decimal, five characters wide, ' ##.#' from 100.

    ``rank_percent`` is the unrounded average, so it is rounded once.
    """
    r = F.round(rank_percent, 1)
    return (F.when(r >= 100, F.lit(" ##.#"))
            .otherwise(F.lpad(F.format_number(r, 1), 5, " ")))


# ------------------------------------------------------------------ SQL twins

def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(sql_str(v) for v in values) + ")"


def sql_s_stem(w: str) -> str:
    return (
        f"CASE WHEN {w} LIKE '%ies' AND NOT ({w} LIKE '%eies' OR {w} LIKE '%aies') "
        f"THEN substr({w}, 1, length({w}) - 3) || 'y' "
        f"WHEN {w} LIKE '%es' AND NOT ({w} LIKE '%aes' OR {w} LIKE '%ees' OR {w} LIKE '%oes') "
        f"THEN substr({w}, 1, length({w}) - 1) "
        f"WHEN {w} LIKE '%s' AND NOT ({w} LIKE '%us' OR {w} LIKE '%ss') "
        f"THEN substr({w}, 1, length({w}) - 1) "
        f"ELSE {w} END"
    )


def sql_lexeme(token: str, cfg: TextConfig | str) -> str:
    cfg = config(cfg) if isinstance(cfg, str) else cfg
    w = f"lower({token})"
    if cfg.forms is not None:
        by = {}
        for word, lexeme in cfg.forms:
            by.setdefault(lexeme, []).append(word)
        whens = " ".join(f"WHEN {w} IN {sql_list(ws)} THEN {sql_str(lx)}" for lx, ws in by.items())
        return f"CASE {whens} END" if by else "CAST(NULL AS STRING)"
    out = sql_s_stem(w) if cfg.stemmer == "s" else w
    if cfg.stopwords:
        out = f"CASE WHEN {w} IN {sql_list(cfg.stopwords)} THEN NULL ELSE {out} END"
    return out


def sql_lexeme_by_language(token: str, language: str, catalogue=LANGUAGE_CONFIGS, stem: bool = True) -> str:
    parts = " ".join(f"WHEN {language} = {sql_str(n)} THEN {sql_lexeme(token, n if stem else words_config(n))}"
                     for n in catalogue)
    return f"CASE {parts} ELSE NULL END"


def sql_known_word(word: str, language: str, catalogue=LANGUAGE_CONFIGS) -> str:
    """Whether a lower-cased word has a lexeme: its language has an analyser, of
    which it is no stopword."""
    tests = []
    for n in catalogue:
        stop = config(n).stopwords
        tests.append(f"({language} = {sql_str(n)}" + (f" AND {word} NOT IN {sql_list(stop)})" if stop else ")"))
    return "(" + " OR ".join(tests) + ")"


def sql_stem_by_language(word: str, language: str, catalogue=LANGUAGE_CONFIGS) -> str:
    """Lexeme of a lower-cased word that ``sql_known_word`` lets through."""
    stemmed = [n for n in catalogue if config(n).stemmer == "s"]
    return f"CASE WHEN {language} IN {sql_list(stemmed)} THEN {sql_s_stem(word)} ELSE {word} END" if stemmed else word


def sql_language_config(language: str, catalogue=LANGUAGE_CONFIGS) -> str:
    return (f"CASE WHEN lower({language}) IN {sql_list(catalogue)} "
            f"THEN lower({language}) END")
