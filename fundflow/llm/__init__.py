"""Operators that prepare text corpora for training: deduplication, filtering,
decontamination, formatting and tokenisation.

Nothing outside this subpackage imports it.
"""
