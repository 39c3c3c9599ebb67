"""Operators of a training-data pipeline: quality, deduplication, extraction, language, tokens."""
