"""Relational operators: ingest, indexing, ranking, search and browsing."""
