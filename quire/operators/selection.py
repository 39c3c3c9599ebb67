"""Filters, selections and row-wise decisions over page, document and job tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.ranges import explode_runs, lenient_pages, strict_pages
from quire.functions.skew import attach

ACTIVE_JOB = ("queued", "running", "cancelling")
TERMINAL_RECOVERABLE = ("failed", "interrupted", "cancelled")


def page_range_strict(df: DataFrame, spec: str = "spec", total: str = "total_pages") -> DataFrame:
    """Adds ``pages`` and ``rejected``; one bad part rejects the whole spec."""
    pages = strict_pages(F.col(spec), F.col(total))
    return df.withColumn("pages", pages).withColumn("rejected", F.col("pages").isNull())


def page_range_lenient(df: DataFrame, spec: str = "spec", total: str = "total_pages") -> DataFrame:
    """Adds ``pages`` and ``rejected``; bad parts are dropped, and only an empty result rejects."""
    pages = lenient_pages(F.col(spec), F.col(total))
    return df.withColumn("pages", pages).withColumn("rejected", F.col("pages").isNull())


def requested_pages(parts: DataFrame, key: str = "spec_id") -> DataFrame:
    """Union of several (key, first, last, total_pages) requests as distinct in-bounds pages.

    A key with any request outside its document yields nothing.
    """
    outside = (F.col("first") < 1) | (F.col("last") > F.col("total_pages"))
    bad = parts.where(outside).select(key).distinct()
    kept = attach(parts, bad, [key], "left_anti").where(~outside)
    run = F.array(F.struct(F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last")))
    return explode_runs(kept, run).select(key, "page_number").distinct()


def review_queue(pages: DataFrame, status: str = "needs_review") -> DataFrame:
    return pages.where(F.col("review_status") == status)


def workflow_step(documents: DataFrame, active_jobs: DataFrame, page_status: DataFrame) -> DataFrame:
    """uploaded, processing, review or approved for the current page of each document."""
    return (
        documents.join(active_jobs.select("document_id").distinct().withColumn("_active", F.lit(True)),
                       "document_id", "left")
        .join(page_status.select("document_id", "review_status"), "document_id", "left")
        .withColumn(
            "step",
            F.when(F.coalesce(F.col("_active"), F.lit(False)), "processing")
            .when(F.col("review_status").isNull(), "uploaded")
            .when(F.col("review_status") == "approved", "approved")
            .otherwise("review"),
        )
        .drop("_active", "review_status")
    )


def apply_patches(
    table: DataFrame,
    patches: DataFrame,
    key: str,
    fields: Mapping[str, str | None],
    rules: Mapping[str, Column] | None = None,
    order: str | None = None,
) -> DataFrame:
    """Sparse update. Of several patches of one key the last by ``order`` counts for each field it gives. ``fields`` maps a column to its "supplied" flag column in the patches, or None
    when a null patch value means "leave alone". ``rules`` then override columns and may refer to
    ``patch_<column>``."""
    if order is not None:
        given = {c: F.col(flag) if flag else F.col(c).isNotNull() for c, flag in fields.items()}
        patches = patches.groupBy(key).agg(
            *[F.max_by(c, F.when(given[c], F.struct(F.col(order), F.col(c)))).alias(c) for c in fields],
            *[F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag) for flag in dict.fromkeys(fields.values()) if flag],
        )
    renamed = patches.select(
        key,
        F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"patch_{c}") for c in fields],
        *[F.col(flag).alias(f"_has_{c}") for c, flag in fields.items() if flag],
    )
    joined = table.join(renamed, key, "left")
    for column, flag in fields.items():
        given = F.coalesce(F.col(f"_has_{column}"), F.lit(False)) if flag else F.col(
            f"patch_{column}"
        ).isNotNull()
        joined = joined.withColumn(
            column, F.when(given, F.col(f"patch_{column}")).otherwise(F.col(column))
        )
    for column, rule in (rules or {}).items():
        joined = joined.withColumn(column, rule)
    return joined.select(*table.columns)


def job_recoverable(rollup: DataFrame) -> DataFrame:
    """Adds ``recoverable`` and ``percent`` done to a job roll-up carrying ``status``."""
    unfinished = F.col("failed_pages") + F.col("cancelled_pages")
    done = F.col("completed_pages") + unfinished
    percent = F.when(
        F.col("total_pages") > 0,
        F.floor(done * F.lit(100.0) / F.col("total_pages") + F.lit(0.5)),
    ).otherwise(F.lit(0))
    return rollup.withColumn(
        "recoverable", F.col("status").isin(*TERMINAL_RECOVERABLE) & (unfinished > 0)
    ).withColumn("percent", percent.cast("int"))


def missing_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages 1..num_pages of each document without a stored page."""
    wanted = documents.select(
        "document_id", F.explode(F.sequence(F.lit(1), F.col("num_pages"))).alias("page_number")
    )
    return wanted.join(pages.select("document_id", "page_number"), ["document_id", "page_number"], "left_anti")


def pages_to_run(
    documents: DataFrame, pages: DataFrame, start: str = "start_page", force: bool = False
) -> DataFrame:
    """Missing pages (every page when forced), the start page leading if it is among them.

    ``run_class`` 0 marks the start page; order by (run_class, page_number).
    """
    wanted = documents.select(
        "document_id", start, F.explode(F.sequence(F.lit(1), F.col("num_pages"))).alias("page_number")
    )
    if not force:
        wanted = wanted.join(
            pages.select("document_id", "page_number"), ["document_id", "page_number"], "left_anti"
        )
        lead = F.when(F.col("page_number") == F.col(start), 0).otherwise(1)
    else:
        lead = F.lit(1)
    return wanted.select("document_id", "page_number", lead.alias("run_class"))


def accent_insensitive_filter(df: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows whose column contains the needle, ignoring case and accents."""
    folded = F.lit(needle.strip())
    return df.where(
        F.contains(F.collate(F.col(column), "UNICODE_CI_AI"), F.collate(folded, "UNICODE_CI_AI"))
    )
