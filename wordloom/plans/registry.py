"""All queries by name, with their SQL twins."""

from __future__ import annotations

from wordloom.plans import corpus_queries, export_queries, lexicon_queries, linguistic_queries, lookup_queries, relational_queries, report_queries, state_queries, text_queries

_ALL = {**corpus_queries.QUERIES, **relational_queries.QUERIES, **report_queries.QUERIES, **state_queries.QUERIES, **linguistic_queries.QUERIES, **lexicon_queries.QUERIES, **lookup_queries.QUERIES, **text_queries.QUERIES, **export_queries.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
