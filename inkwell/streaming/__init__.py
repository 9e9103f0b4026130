"""Structured Streaming forms of the ingest and log operators."""
