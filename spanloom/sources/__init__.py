"""Readers: corpora, source trees, raw chunks, session logs and benchmark tables."""
