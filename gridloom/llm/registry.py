"""The queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from gridloom.llm import doc_fingerprints, language_id, line_dedup, lm_scoring, ngram_join, pack_windows, personal_data, phrase_mining, piece_codec, quality_rules, ranked_search, token_counts, toxicity

MODULES = (ngram_join, quality_rules, line_dedup, toxicity, lm_scoring, piece_codec, token_counts, pack_windows, personal_data, doc_fingerprints, phrase_mining, language_id, ranked_search)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
