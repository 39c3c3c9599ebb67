"""Equi-joins over the ownership tree: enrichment, scoping, audits, cascades, correlation.

Dimension sides are left to the size-checked broadcast of the optimiser; nothing is hinted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.skew import attach


def search_enrich(hits: DataFrame, documents: DataFrame, sessions: DataFrame,
                  projects: DataFrame, pages: DataFrame) -> DataFrame:
    """Hit rows with document, session, page and, where there is one, project columns."""
    named = attach(
        hits, documents.select("document_id", "document_name", "session_id"), ["document_id"], "inner"
    )
    titled = attach(
        named, sessions.select("session_id", "session_title", "project_id", "session_updated_at"),
        ["session_id"], "inner",
    )
    placed = attach(titled, projects.select("project_id", "project_name"), ["project_id"])
    return placed.join(
        pages.select("document_id", "page_number", "review_status", "confidence_score"),
        ["document_id", "page_number"],
    )


def owner_scoped(rows: DataFrame, sessions: DataFrame, user_id: Column | int) -> DataFrame:
    """Rows whose session belongs to the owner."""
    owned = sessions.where(F.col("user_id") == user_id).select("session_id")
    return attach(rows, owned, ["session_id"], "left_semi")


def print_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Every page 1..num_pages with ``has_ocr``; absent pages have empty text."""
    wanted = documents.select(
        "document_id", F.explode(F.sequence(F.lit(1), F.col("num_pages"))).alias("page_number")
    )
    stored = pages.select("document_id", "page_number", "markdown", F.lit(True).alias("_stored"))
    return wanted.join(stored, ["document_id", "page_number"], "left").select(
        "document_id",
        "page_number",
        F.coalesce("_stored", F.lit(False)).alias("has_ocr"),
        F.coalesce("markdown", F.lit("")).alias("markdown"),
    )


def project_session_counts(projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Non-archived sessions per project; projects without any keep zero.

    Sessions are counted before the join, so one huge project meets the join as one row.
    """
    counts = (
        sessions.where(~F.col("is_archived")).groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    )
    return projects.join(counts, "project_id", "left").withColumn(
        "session_count", F.coalesce("_n", F.lit(0))
    ).drop("_n")


def delete_cascade(tables: Sequence[tuple[DataFrame, str]], deleted: DataFrame, key: str) -> list[DataFrame]:
    """Remove deleted keys from each (table, key column)."""
    return [
        attach(table, deleted.select(F.col(key).alias(column)), [column], "left_anti")
        for table, column in tables
    ]


def delete_set_null(children: DataFrame, deleted: DataFrame, key: str, column: str) -> DataFrame:
    """Keep the children of deleted parents, with the reference cleared."""
    gone = deleted.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    return attach(children, gone, [column]).withColumn(
        column, F.when(F.col("_gone").isNull(), F.col(column))
    ).select(*children.columns)


def batch_correlate(requested: DataFrame, results: DataFrame, key: str = "custom_id", order: str | None = None) -> DataFrame:
    """Requested pages with their result by id, in any order of lines.

    An id reported as an error, by either file, is an error; one without any line gets its own. Of
    several lines of one id the last by ``order`` counts, by default the greatest text.
    """
    by = [F.col(order)] if order else []
    found = results.groupBy(key).agg(
        F.max_by("markdown", F.when(F.col("markdown").isNotNull(), F.struct(*by, F.col("markdown")))).alias("_markdown"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.struct(*by, F.col("error")))).alias("_error"),
        F.lit(True).alias("_found"),
    )
    error = F.when(F.col("_found").isNull(), "no result for this page").otherwise(F.col("_error"))
    return (
        requested.join(found, key, "left")
        .withColumn("error", error)
        .withColumn("markdown", F.when(F.col("error").isNull(), F.col("_markdown")))
        .drop("_markdown", "_error", "_found")
    )


def reject_stale(results: DataFrame, documents: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Adds ``reject_reason``; null marks a result that may be stored.

    ``results`` carry ``expected_checksum`` (null passes). With ``running`` pages given, a result
    for a page that no longer runs is rejected too.
    """
    current = documents.select(
        "document_id", F.col("checksum").alias("_checksum"), F.lit(True).alias("_exists")
    )
    joined = attach(results, current, ["document_id"])
    reason = F.when(F.col("_exists").isNull(), "document_missing").when(
        F.col("expected_checksum").isNotNull()
        & ~F.col("expected_checksum").eqNullSafe(F.col("_checksum")),
        "content_changed",
    )
    if running is not None:
        alive = running.select("document_id", "page_number").distinct().withColumn("_running", F.lit(True))
        joined = attach(joined, alive, ["document_id", "page_number"])
        reason = reason.when(F.col("_running").isNull(), "page_not_running")
    return joined.withColumn("reject_reason", reason).drop("_checksum", "_exists", "_running")


def find_duplicate_upload(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``stored_id`` and ``duplicate``: content already in the session keeps its smallest stored id.

    Among new uploads of one content the smallest id is stored and the others reuse it.
    """
    key = ["session_id", "checksum"]
    marked = existing.select(*key, "document_id", F.lit(True).alias("_old")).union(
        incoming.select(*key, "document_id", F.lit(False))
    )
    known = marked.groupBy(*key).agg(
        F.min(F.when(F.col("_old"), F.col("document_id"))).alias("_stored"),
        F.min("document_id").alias("_first"),
    )
    stored = F.coalesce("_stored", "_first", "document_id")
    return (
        attach(incoming, known, key)
        .withColumn("stored_id", stored)
        .withColumn("duplicate", F.col("_stored").isNotNull() | (F.col("stored_id") != F.col("document_id")))
        .drop("_stored", "_first")
    )


def fk_audit(links: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Orphan keys per (name, child, child column, parent, parent column), counted."""
    orphans = [
        child.where(F.col(child_key).isNotNull())
        .groupBy(F.col(child_key).cast("string").alias("orphan_key"))
        .agg(F.count(F.lit(1)).alias("child_rows"))
        .join(parent.select(F.col(parent_key).cast("string").alias("orphan_key")), "orphan_key", "left_anti")
        .select(F.lit(name).alias("foreign_key"), "orphan_key", "child_rows")
        for name, child, child_key, parent, parent_key in links
    ]
    return reduce(DataFrame.unionByName, orphans)


def edits_over_cache(keys: DataFrame, edits: DataFrame, cache: DataFrame) -> DataFrame:
    """User edit, else cached OCR, else empty text."""
    on = ["document_id", "page_number"]
    return (
        keys.join(edits.select(*on, F.col("markdown").alias("_edit")), on, "left")
        .join(cache.select(*on, F.col("markdown").alias("_cached")), on, "left")
        .withColumn("markdown", F.coalesce("_edit", "_cached", F.lit("")))
        .drop("_edit", "_cached")
    )


def unique_audit(name: str, df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Key values that occur more than once."""
    label = F.concat_ws("|", *[k.cast("string") for k in keys])
    return (
        df.groupBy(label.alias("key"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where("row_count > 1")
        .select(F.lit(name).alias("rule"), "key", "row_count")
    )
