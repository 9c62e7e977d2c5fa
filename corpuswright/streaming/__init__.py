"""Structured Streaming variants of append-only operators."""
