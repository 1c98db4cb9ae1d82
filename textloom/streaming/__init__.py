"""Incremental vocabularies and indexes on Structured Streaming."""
