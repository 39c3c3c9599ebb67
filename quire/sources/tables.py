"""Ledgers, schema evolution, backfills and metadata-only scans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METADATA = ("document_id", "session_id", "name", "mime_type", "is_pdf", "num_pages", "current_page",
            "document_type", "checksum", "created_at")


def page_metadata_scan(documents: DataFrame, heavy: tuple[str, ...] = ("content",)) -> DataFrame:
    """Every column but the heavy ones, so the scan never reads them."""
    return documents.select(*[c for c in documents.columns if c not in heavy])


def ledger_unapplied(inputs: DataFrame, ledger: DataFrame, key: str = "version") -> DataFrame:
    """Inputs the ledger does not list; apply them in key order."""
    return inputs.join(ledger.select(key), key, "left_anti")


def add_missing_columns(df: DataFrame, defaults: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Adds each absent column as (type, default)."""
    added = {
        name: F.lit(default).cast(kind) for name, (kind, default) in defaults.items() if name not in df.columns
    }
    return df.withColumns(added) if added else df


def backfill_checksum(documents: DataFrame) -> DataFrame:
    """Fills null checksums only."""
    return documents.withColumn("checksum", F.coalesce("checksum", F.sha2("content", 256)))
