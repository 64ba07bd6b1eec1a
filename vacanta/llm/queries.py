"""All queries of the subpackage and their SQL twins."""

from __future__ import annotations

from vacanta.llm import queries_bpe, queries_chat, queries_decontaminate, queries_forest, queries_html, queries_language, queries_lm, queries_minhash, queries_packing, queries_quality, queries_spelling, queries_urls, queries_whitening

_MODULES = (queries_chat, queries_bpe, queries_decontaminate, queries_forest, queries_html, queries_language, queries_lm, queries_minhash, queries_packing, queries_quality, queries_spelling, queries_urls, queries_whitening)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
