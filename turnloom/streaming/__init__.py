"""Structured Streaming forms of the row-wise turn jobs."""
