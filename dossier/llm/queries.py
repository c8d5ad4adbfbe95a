"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from dossier.llm import bytepair_query, chats_query, fingerprints_query, language_query, linededup_query, neardup_query, packing_query, privacy_query, quality_query, resampling_query, secrets_query, spelling_query, wordpair_query

_MODULES = (
    bytepair_query, chats_query, fingerprints_query, language_query, linededup_query, neardup_query, packing_query, privacy_query, quality_query, resampling_query, secrets_query,
    spelling_query, wordpair_query,
)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
