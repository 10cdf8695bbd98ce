"""Structured Streaming ingest of interactions and feedback."""
