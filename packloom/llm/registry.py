"""Queries and SQL of the text-corpus operators."""

from . import chat, decontamination, exact_dedup, html_extraction, lexical_search, line_dedup, merkle_manifest, ngram_join, quality_classifier, secrets, sentencepiece_codec, substring_dedup, toxicity

_MODULES = [exact_dedup, secrets, ngram_join, line_dedup, sentencepiece_codec, decontamination, chat, toxicity, substring_dedup, html_extraction, lexical_search, merkle_manifest, quality_classifier]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
