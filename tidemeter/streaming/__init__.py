"""Structured Streaming forms of ingestion and aggregation."""
