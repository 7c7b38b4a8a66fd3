"""Column expressions: tokeniser, analysers, formatting helpers."""

from .text import (ALL_LANGUAGES, CONFIGS, LANGUAGE_CONFIGS, PIECE_PATTERN, WORD_PATTERN,
                   TextConfig, config, language_config, lexeme,
                   lexeme_by_language, pieces, rank_text, s_stem,
                   sentinel_null, title_link, tokens)
from .stopwords import stopwords

__all__ = [
    "ALL_LANGUAGES", "CONFIGS", "LANGUAGE_CONFIGS", "PIECE_PATTERN", "WORD_PATTERN",
    "TextConfig", "config", "language_config", "lexeme", "lexeme_by_language",
    "pieces", "rank_text", "s_stem", "sentinel_null", "stopwords",
    "title_link", "tokens",
]
