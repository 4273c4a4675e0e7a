"""Structured Streaming: ingestion, batch completion, debounced text."""
