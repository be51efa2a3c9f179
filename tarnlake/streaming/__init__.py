"""Structured Streaming forms of ingestion and reports."""
