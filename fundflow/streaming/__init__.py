"""Structured Streaming layer."""
