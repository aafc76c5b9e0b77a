"""Structured Streaming forms of the row-local pipeline."""
