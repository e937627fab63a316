"""All queries outside ``llm``, with their SQL."""

from __future__ import annotations

from kelpline import queries_feed, queries_kv, queries_vectors

QUERIES = {**queries_feed.QUERIES, **queries_vectors.QUERIES, **queries_kv.QUERIES}
ORACLE = {**queries_feed.ORACLE, **queries_vectors.ORACLE, **queries_kv.ORACLE}
