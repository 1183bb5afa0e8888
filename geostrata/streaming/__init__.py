"""Structured Streaming: ingestion, continuous queries and sliding counts."""
