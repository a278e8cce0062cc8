"""Structured Streaming forms: log summaries and scoring."""
