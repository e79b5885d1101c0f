"""Structured Streaming forms of the scoring and reporting jobs."""
