"""Structured Streaming forms of counting, scoring and training."""
