"""Structured Streaming forms of operators whose results are running sums."""
