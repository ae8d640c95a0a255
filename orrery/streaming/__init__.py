"""Structured Streaming forms of ingestion and timelines."""
