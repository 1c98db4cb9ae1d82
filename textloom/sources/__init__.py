"""Corpus readers, result writers and profile storage."""
