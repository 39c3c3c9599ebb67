"""Roll-ups. Every one combines map-side, and lists are built per bounded block of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.binding import computed
from quire.functions.ranking import number_rows
from quire.functions.skew import attach
from quire.functions.tokens import tokens, word_count

PAGES_PER_MINUTE = 1250
TARGET_UTILIZATION = 0.88


def _is(status: str) -> Column:
    return F.col("status") == status


def job_rollup(job_pages: DataFrame) -> DataFrame:
    return job_pages.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(_is("completed")).alias("completed_pages"),
        F.count_if(_is("failed")).alias("failed_pages"),
        F.count_if(_is("cancelled")).alias("cancelled_pages"),
        F.min(F.when(_is("running"), F.col("page_number"))).alias("current_page"),
    )


def document_page_lists(pages: DataFrame, block: int = 4096) -> DataFrame:
    """Ordered completed, approved and needs_review page numbers per document.

    One row per document and block of ``block`` page numbers; ordinary documents have one block,
    and a document of any length never meets in one row.
    """
    page = F.col("page_number")
    return pages.groupBy(
        "document_id", F.floor((page - 1) / F.lit(block)).alias("block")
    ).agg(
        F.array_sort(F.collect_list(page)).alias("completed_pages"),
        F.array_sort(
            F.collect_list(F.when(F.col("review_status") == "approved", page))
        ).alias("approved_pages"),
        F.array_sort(
            F.collect_list(F.when(F.col("review_status") == "needs_review", page))
        ).alias("needs_review_pages"),
    )


def ocr_page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("ocr_pages"))


def assign_sort_order(
    existing: DataFrame, new: DataFrame, owner: str, bucket: Column, order: Sequence[Column]
) -> DataFrame:
    """New rows with the numbers following the owner's largest ``sort_order``."""
    top = existing.groupBy(owner).agg(F.max("sort_order").alias("_top"))
    numbered = number_rows(new, [owner], bucket, order, "_rank")
    return attach(numbered, top, [owner]).withColumn(
        "sort_order", F.coalesce("_top", F.lit(-1)) + F.col("_rank")
    ).drop("_top", "_rank")


def finalize_jobs(job_pages: DataFrame, jobs: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """Jobs without a queued or running page; failed ones name how many pages failed.

    With ``jobs`` (job_id, status) only those that are still queued or running themselves end, and
    ``finished_at`` is set to ``at``.
    """
    counted = job_pages.groupBy("job_id").agg(
        F.count_if(F.col("status").isin("queued", "running")).alias("_pending"),
        F.count_if(_is("failed")).alias("_failed"),
    )
    ending = counted.where("_pending = 0")
    stamp = []
    if jobs is not None:
        live = jobs.where(F.col("status").isin("queued", "running")).select("job_id")
        ending = ending.join(live, "job_id", "left_semi")
        stamp = [(at if at is not None else F.current_timestamp()).alias("finished_at")]
    return ending.select(
        "job_id",
        F.when(F.col("_failed") > 0, "failed").otherwise("completed").alias("status"),
        F.when(
            F.col("_failed") > 0, F.concat(F.col("_failed").cast("string"), F.lit(" page(s) failed"))
        ).alias("error"),
        *stamp,
    )


def throughput_report(job_pages: DataFrame, target: float = PAGES_PER_MINUTE * TARGET_UTILIZATION) -> DataFrame:
    """Per mode: pages, elapsed seconds, pages per minute, percent of target, fastest mode, speed ratio.

    The few mode rows are compared through one scalar subquery.
    """
    modes = job_pages.groupBy("processing_mode").agg(
        F.count_if(_is("completed")).alias("completed_pages"),
        F.count_if(_is("failed")).alias("failed_pages"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("_span"),
    ).withColumn("elapsed_seconds", F.col("_span") / 1e6)
    ppm = F.col("completed_pages") * 60.0 / F.greatest(F.lit(0.001), F.col("elapsed_seconds"))
    fastest = modes.agg(
        F.struct(
            F.min_by("processing_mode", F.struct("elapsed_seconds", "processing_mode")).alias("mode"),
            F.max(F.when(F.col("processing_mode") == "realtime", F.col("elapsed_seconds"))).alias("rt"),
            F.max(F.when(F.col("processing_mode") == "batch", F.col("elapsed_seconds"))).alias("b"),
        ).alias("best")
    )
    with_best = modes.withColumn("_best", fastest.select("best").scalar())
    return with_best.select(
        "processing_mode",
        "completed_pages",
        "failed_pages",
        F.round("elapsed_seconds", 3).alias("elapsed_seconds"),
        F.round(ppm, 2).alias("pages_per_minute"),
        F.round(ppm / F.greatest(F.lit(1.0), F.lit(float(target))) * 100.0, 2).alias("target_percent"),
        F.col("_best.mode").alias("faster_mode"),
        F.round(F.col("_best.rt") / F.greatest(F.lit(0.001), F.col("_best.b")), 3).alias("speed_ratio"),
    )


def corpus_size(pages: DataFrame) -> DataFrame:
    """One row: number of pages and average tokens per page."""
    return pages.agg(
        F.count(F.lit(1)).alias("n_pages"), F.avg(F.size(tokens(F.col("markdown")))).alias("avg_length")
    )


def corpus_stats(pages: DataFrame) -> DataFrame:
    """Pages containing each token, beside corpus size and average length.

    A page is tokenised once: its distinct tokens, and one row without a token for its length, are counted in the
    same aggregate, which combines before its shuffle.
    """
    split = computed(pages, "_tokens", F.coalesce(tokens(F.col("markdown")), F.array().cast("array<string>")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("token"), F.when(F.col("markdown").isNotNull(), F.size("_tokens")).alias("dl")))
    each = F.transform(F.array_distinct("_tokens"), lambda t: F.struct(t.alias("token"), F.lit(None).cast("int").alias("dl")))
    counted = split.select(F.inline(F.concat(whole, each))).groupBy("token").agg(
        F.count(F.lit(1)).alias("page_frequency"), F.avg("dl").alias("avg_length")
    )
    # both filters are on the aggregate, so that neither is pushed below it and its shuffle serves both
    size = counted.where("avg_length IS NOT NULL").select(F.struct(F.col("page_frequency").alias("n_pages"), "avg_length").alias("s"))
    return counted.where("avg_length IS NULL").drop("avg_length").withColumn("_s", size.scalar()).select(
        "token", "page_frequency", F.col("_s.n_pages").alias("n_pages"), F.round(F.col("_s.avg_length"), 6).alias("avg_length")
    )


def ewma_parts(
    samples: DataFrame, keys: Sequence[str], value: str, bucket: Column, newest: Sequence[Column],
    keep: float = 0.8,
) -> DataFrame:
    """Per key: ``n`` positive samples, their discounted sum ``s`` and the ``first`` one.

    The ordered fold is linear: a sample followed by r later ones weighs (1-keep)*keep**r. Rows are numbered from
    the newest on, see :func:`number_rows`, and weighted samples are summed with combination before the shuffle,
    so no key and no time bucket is folded in one task. ``newest`` orders samples from the newest on; ``bucket``
    grows with time.
    """
    keys = list(keys)
    numbered = number_rows(samples.where(F.col(value) > 0), keys, bucket, newest, "_age", newest_first=True)
    weight = (1.0 - keep) * F.pow(F.lit(keep), F.col("_age") - 1)
    return numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(value) * weight).alias("s"), F.max_by(value, "_age").alias("first")
    )


def merge_ewma(parts: DataFrame, keys: Sequence[str], order: str, keep: float = 0.8) -> DataFrame:
    """One (n, s, first) row per key from several in ``order``; the result can be merged again."""
    newer = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.sum("n").over(newer), F.lit(0))
    return parts.withColumn("_later", later).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("s") * F.pow(F.lit(keep), F.col("_later"))).alias("s"),
        F.min_by("first", order).alias("first"),
    )


def ewma_value(parts: DataFrame, keys: Sequence[str], keep: float = 0.8) -> DataFrame:
    """The first sample seeds the average instead of entering with the small weight."""
    seeded = F.col("s") + F.col("first") * F.pow(F.lit(keep), F.col("n"))
    return parts.select(*keys, seeded.alias("ewma"), F.col("n").alias("samples"))


def latency_ewma(
    samples: DataFrame, key: str, value: str, bucket: Column, newest: Sequence[Column], keep: float = 0.8
) -> DataFrame:
    """Moving average per key over positive samples."""
    return ewma_value(ewma_parts(samples, [key], value, bucket, newest, keep), [key], keep)


def dedup_checksum(documents: DataFrame, keys: Sequence[str] = ("session_id", "checksum")) -> DataFrame:
    """Smallest document id per distinct content, with the number of copies."""
    return documents.groupBy(*keys).agg(
        F.min("document_id").alias("document_id"), F.count(F.lit(1)).alias("copies")
    )


def short_content_id(content: Column) -> Column:
    """First twelve hex digits of SHA-1."""
    return F.substr(F.sha1(content), F.lit(1), F.lit(12))


def word_counts(pages: DataFrame) -> DataFrame:
    """Words per document, summed from its pages."""
    return pages.groupBy("document_id").agg(
        F.sum(word_count(F.col("markdown")).cast("bigint")).alias("words"),
        F.count(F.lit(1)).alias("pages"),
    )


def page_word_counts(pages: DataFrame) -> DataFrame:
    return pages.select("document_id", "page_number", word_count(F.col("markdown")).alias("words"))


def scheduler_snapshot(
    attempts: DataFrame,
    latest_ewma: DataFrame,
    limit: int = PAGES_PER_MINUTE,
    utilization: float = TARGET_UTILIZATION,
) -> DataFrame:
    """One row per mode: limits, samples, rate-limit events and the latest moving average."""
    counted = attempts.groupBy("processing_mode").agg(
        F.count_if(F.col("duration_seconds") > 0).alias("samples"),
        F.count_if(F.col("rate_limited")).alias("rate_limit_events"),
        F.max_by("status", F.struct("ts", "event_id")).alias("last_status"),
    )
    latest = latest_ewma.select("processing_mode", "ewma")
    return counted.join(latest, "processing_mode", "left").select(
        "processing_mode",
        F.lit(limit).alias("pages_per_minute_limit"),
        F.lit(round(limit * utilization)).alias("target_pages_per_minute"),
        "samples",
        "rate_limit_events",
        "last_status",
        F.round("ewma", 3).alias("average_page_seconds"),
    )
