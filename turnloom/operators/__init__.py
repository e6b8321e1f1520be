"""Operators on whole tables, DataFrame in and DataFrame out."""
