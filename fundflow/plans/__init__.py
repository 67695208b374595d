"""Iterative plans: what a single query can't express."""
