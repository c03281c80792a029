"""Structured Streaming forms: they go beyond the batch operators and share their definitions."""
