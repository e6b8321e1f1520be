"""Training-data operators: decontamination, deduplication, scoring, extraction, tokens and archives.

Nothing else in the library imports this subpackage.
"""
