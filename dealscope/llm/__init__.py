"""Operators for large text corpora: dedup, tokenising, mixing, extraction, scoring.

Nothing else in the library imports this subpackage.
"""
