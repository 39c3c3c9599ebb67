"""Readers and row builders for files, provider lines, logs and ledgers."""
