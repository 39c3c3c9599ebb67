"""Ranking and top-k. A small fixed k is cut map-side before the shuffle; full numberings use blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.ranking import number_rows, page_block
from quire.functions.skew import flag_first
from quire.functions.text import decode_data_url
from quire.operators.selection import ACTIVE_JOB


def next_pages(job_pages: DataFrame, k: int = 1) -> DataFrame:
    """The k next queued pages of each job: highest priority, then lowest page."""
    order = Window.partitionBy("job_id").orderBy(F.desc("priority"), F.asc("page_number"))
    return (
        job_pages.where(F.col("status") == "queued")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
    )


def resolve_claims(
    claims: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Marks each claim ``won`` (earliest of its key in ``order``) or ``duplicate_claim``.

    ``order`` must tell any two claims of a key apart.
    """
    flagged = flag_first(claims, keys, [F.col(c) for c in order], order, "_won")
    return flagged.withColumn(
        "outcome", F.when(F.col("_won"), "won").otherwise("duplicate_claim")
    ).drop("_won")


def release_claims(held: DataFrame, releases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claims left after releases; a release only removes its own owner's claim."""
    return held.join(releases, [*keys, "owner_token"], "left_anti")


def latest_job(jobs: DataFrame) -> DataFrame:
    """Newest job per document, ties broken by the larger id."""
    newest = F.max(F.struct("created_at", "job_id", "status")).alias("_latest")
    return jobs.groupBy("document_id").agg(newest).select(
        "document_id", "_latest.job_id", "_latest.status", "_latest.created_at"
    )


def active_job(jobs: DataFrame) -> DataFrame:
    return latest_job(jobs.where(F.col("status").isin(*ACTIVE_JOB)))


def micro_batches(job_pages: DataFrame, size: int = 8) -> DataFrame:
    """Adds ``batch_number`` (from 0) to queued pages in dequeue order, ``size`` pages each."""
    queued = job_pages.where(F.col("status") == "queued")
    bucket = F.struct((-F.col("priority")).alias("p"), page_block(F.col("page_number")).alias("b"))
    numbered = number_rows(queued, ["job_id"], bucket, [F.asc("page_number")], "_position")
    return numbered.withColumn(
        "batch_number", F.floor((F.col("_position") - 1) / F.lit(size))
    ).drop("_position")


def asset_ordinals(pages: DataFrame, images: str = "images") -> DataFrame:
    """Decodable images of each page with their ordinal; undecodable ones use up no number."""
    ids = [c for c in pages.columns if c != images]
    decoded = F.filter(
        F.transform(
            F.col(images),
            lambda image: F.struct(
                image["id"].alias("source_ref"),
                decode_data_url(image["image_base64"], image["id"]).alias("asset"),
            ),
        ),
        lambda d: d["asset"]["error"].isNull(),
    )
    return pages.select(*ids, F.posexplode(decoded).alias("_pos", "_image")).select(
        *ids,
        (F.col("_pos") + 1).alias("ordinal"),
        "_image.source_ref",
        F.col("_image.asset.mime_type").alias("mime_type"),
        F.col("_image.asset.extension").alias("extension"),
        F.col("_image.asset.content").alias("content"),
    )


def throughput_windows(
    samples: DataFrame, key: str, bucket: Column, order: Sequence[Column], concurrency: int = 4
) -> DataFrame:
    """Full windows of max(8, 2*concurrency) successes: pages per second, and whether it improved.

    Each window also sends its rate to the next window number, and the two meet by (key, number),
    so the windows of one key never sort in one task.
    """
    size = max(8, 2 * concurrency)
    numbered = number_rows(samples, [key], bucket, order, "_rank")
    windows = (
        numbered.withColumn("window_number", F.floor((F.col("_rank") - 1) / F.lit(size)))
        .groupBy(key, "window_number")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            ((F.max(F.unix_micros(F.col("ts").cast("timestamp")))
              - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 1e6).alias("elapsed_seconds"),
        )
        .where(F.col("pages") == size)
        .withColumn(
            "pages_per_second", F.col("pages") / F.greatest(F.lit(0.001), F.col("elapsed_seconds"))
        )
    )
    sent = F.array(
        F.struct(
            F.col("window_number").alias("at"), F.col("pages").alias("pages"),
            F.col("elapsed_seconds").alias("elapsed_seconds"), F.col("pages_per_second").alias("own"),
            F.lit(None).cast("double").alias("previous"),
        ),
        F.struct(
            (F.col("window_number") + 1).alias("at"), F.lit(None).cast("bigint").alias("pages"),
            F.lit(None).cast("double").alias("elapsed_seconds"), F.lit(None).cast("double").alias("own"),
            F.col("pages_per_second").alias("previous"),
        ),
    )
    met = windows.select(key, F.inline(sent)).groupBy(key, F.col("at").alias("window_number")).agg(
        F.max("pages").alias("pages"), F.max("elapsed_seconds").alias("elapsed_seconds"),
        F.max("own").alias("pages_per_second"), F.max("previous").alias("_previous"),
    )
    return met.where(F.col("pages").isNotNull()).select(
        key,
        "window_number",
        "pages",
        F.round("elapsed_seconds", 6).alias("elapsed_seconds"),
        F.round("pages_per_second", 6).alias("pages_per_second"),
        (F.col("_previous").isNull() | (F.col("pages_per_second") >= F.col("_previous") * 1.05)).alias(
            "improved"
        ),
    )


def search_top_k(hits: DataFrame, limit: int = 30) -> DataFrame:
    """Best hits by score, then newest session, at least one."""
    return hits.orderBy(
        F.desc("score"), F.desc("updated_at"), F.asc("document_id"), F.asc("page_number")
    ).limit(max(1, limit))
