"""Spark jobs that build, check and score dialogue datasets."""
