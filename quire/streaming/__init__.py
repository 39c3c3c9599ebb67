"""Structured Streaming variants of the incremental operators."""
