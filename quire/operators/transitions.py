"""State transitions: each returns the next version of a page, job or extraction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.ranges import explode_runs
from quire.functions.skew import attach
from quire.operators.selection import ACTIVE_JOB

REVIEW_THRESHOLD = 0.80
REVIEW_STATUSES = ("unreviewed", "needs_review", "approved")
TOP_PRIORITY = 1000
MAX_ATTEMPTS = 3
_PAGE = ["document_id", "page_number"]
_GIVEN = ("processing_mode", "remote_batch_id")
_TERMINAL_PAGE = ("completed", "failed", "cancelled")


def initial_review_status(markdown: Column, confidence: Column, is_ocr: Column) -> Column:
    """OCR results that are blank or below the confidence threshold need review."""
    blank = ~markdown.rlike(r"(?U)\S")
    doubtful = blank | F.coalesce(confidence < REVIEW_THRESHOLD, F.lit(False))
    return F.when(is_ocr & doubtful, "needs_review").otherwise("unreviewed")


def last_by_key(rows: DataFrame, key: Sequence[str], order: str | None) -> DataFrame:
    """The row of each key with the greatest ``order``, equal orders by the row's content. Without an order
    column keys must not repeat."""
    if order is None:
        return rows
    rest = [c for c in rows.columns if c not in key]
    comparable = [F.to_json(F.struct(*rest))]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), *comparable)).alias("_last"))
    return last.select(*key, "_last.*")


def upsert_pages(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Page table after OCR results and edits. A row with source text is an OCR result.

    OCR replaces text, confidence, report and source; a plain edit keeps those three.
    Either resets the review. Both sides carry document_id, page_number, source_markdown,
    markdown, preprocessing_json, confidence_score; the old one review_status and reviewed_at too.
    With ``order``, a column of ``new``, a page may have several rows there: the last one gives text
    and review, the last OCR result among them the other three.
    """
    fields = ("source_markdown", "markdown", "preprocessing_json", "confidence_score")
    if order is None:
        n = new.withColumn("_last_ocr", F.col("source_markdown").isNotNull())
    else:
        by = F.struct(F.col(order), F.col("markdown"))
        ocr = F.col("source_markdown").isNotNull()
        kept = ("source_markdown", "preprocessing_json", "confidence_score")
        n = new.groupBy(*_PAGE).agg(
            F.max_by(F.struct("markdown", ocr.alias("ocr")), by).alias("_e"),
            F.max_by(F.struct(*kept), F.when(ocr, by)).alias("_o"),
        ).select(*_PAGE, "_e.markdown", F.col("_e.ocr").alias("_last_ocr"), "_o.*")
    n = n.select(*_PAGE, F.lit(True).alias("_new"), "_last_ocr", *[F.col(c).alias(f"_n_{c}") for c in fields])
    joined = old.join(n, _PAGE, "full_outer")
    touched = F.coalesce("_new", F.lit(False))
    is_ocr = F.col("_n_source_markdown").isNotNull()
    status = initial_review_status(F.col("_n_markdown"), F.col("_n_confidence_score"), F.coalesce("_last_ocr", F.lit(False)))
    return joined.select(
        *_PAGE,
        F.coalesce("_n_source_markdown", "source_markdown").alias("source_markdown"),
        F.when(touched, F.col("_n_markdown")).otherwise(F.col("markdown")).alias("markdown"),
        F.when(is_ocr, F.col("_n_preprocessing_json")).otherwise(F.col("preprocessing_json")).alias(
            "preprocessing_json"
        ),
        F.when(is_ocr, F.col("_n_confidence_score")).otherwise(F.col("confidence_score")).alias(
            "confidence_score"
        ),
        F.when(touched, status).otherwise(F.col("review_status")).alias("review_status"),
        F.when(~touched, F.col("reviewed_at")).alias("reviewed_at"),
    )


def replace_page_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Assets of each page present in ``new`` are replaced as a whole."""
    touched = new.select(*_PAGE).distinct()
    return old.join(touched, _PAGE, "left_anti").unionByName(new)


def apply_reviews(pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pages with the new status of the last valid review by ``at``; only approval sets reviewed_at."""
    valid = reviews.where(F.col("status").isin(*REVIEW_STATUSES)).groupBy(*_PAGE).agg(
        F.max_by("status", F.struct("at", "status")).alias("_status"), F.max("at").alias("_at")
    )
    given = F.col("_status").isNotNull()
    return (
        pages.join(valid, _PAGE, "left")
        .withColumn(
            "reviewed_at",
            F.when(given, F.when(F.col("_status") == "approved", F.col("_at"))).otherwise(
                F.col("reviewed_at")
            ),
        )
        .withColumn("review_status", F.coalesce("_status", "review_status"))
        .drop("_status", "_at")
    )


def rejected_reviews(pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews with an unknown status or for a page that was never stored."""
    known = pages.select(*_PAGE, F.lit(True).alias("_known"))
    reason = F.when(~F.col("status").isin(*REVIEW_STATUSES), "unknown_status").when(
        F.col("_known").isNull(), "page_missing"
    )
    return reviews.join(known, _PAGE, "left").withColumn("reason", reason).drop("_known").where(
        F.col("reason").isNotNull()
    )


def upsert_extractions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Extraction table keyed (document_id, profile); the first created_at stays.

    ``new`` carries data_json, schema_version, status, model and ``at``; of a repeated key the row
    with the last ``at`` counts, and a key that is new was created at its first.
    """
    key = ["document_id", "profile"]
    fields = ("data_json", "schema_version", "status", "model")
    last = F.max(F.struct("at", *fields)).alias("_last")  # rows of equal ``at`` by their fields
    n = new.groupBy(*key).agg(last, F.min("at").alias("_first"))
    n = n.select(*key, F.col("_last.at").alias("_at"), "_first", *[F.col(f"_last.{c}").alias(f"_n_{c}") for c in fields])
    touched = F.col("_at").isNotNull()
    return old.join(n, key, "full_outer").select(
        *key,
        *[F.when(touched, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        F.when(touched, F.when(F.col("_n_status") == "approved", F.col("_at")))
        .otherwise(F.col("reviewed_at")).alias("reviewed_at"),
        F.coalesce("created_at", "_first").alias("created_at"),
    )


def create_jobs(documents: DataFrame, pages: DataFrame, force: bool = False) -> DataFrame:
    """Job pages of new jobs, one per document (``job_id``, ``num_pages``; optional ``pages`` array).

    Pages already stored start completed unless forced.
    """
    jobs = documents.select("job_id", "document_id", *(c for c in ("pages", "num_pages") if c in documents.columns))
    if "pages" in documents.columns:
        wanted = jobs.withColumn("page_number", F.explode(F.array_distinct("pages")))
    else:
        whole = F.array(F.struct(F.lit(1).cast("bigint").alias("first"), F.col("num_pages").cast("bigint").alias("last")))
        wanted = explode_runs(jobs.where(F.col("num_pages") >= 1), whole)
    wanted = wanted.select("job_id", "document_id", "page_number")
    if force:
        return wanted.withColumn("status", F.lit("queued"))
    done = pages.select(*_PAGE, F.lit(True).alias("_done"))
    return wanted.join(done, _PAGE, "left").withColumn(
        "status", F.when(F.col("_done"), "completed").otherwise("queued")
    ).drop("_done")


def new_job_rows(documents: DataFrame, rate_limit: int = 1250, force: bool = False) -> DataFrame:
    """Job rows of new jobs, remembering the document's checksum at submission."""
    return documents.select(
        "job_id", "document_id",
        F.lit("queued").alias("status"), F.lit("adaptive").alias("processing_mode"),
        F.lit(force).alias("force_reprocess"), F.lit(False).alias("cancel_requested"),
        F.col("checksum").alias("document_checksum"), F.lit(max(1, rate_limit)).alias("rate_limit_ppm"),
    )


def prioritize_pages(job_pages: DataFrame, requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requested pages of queued or running jobs move to the front; running pages stay as they are.

    A requested page the job lacks is added; requests outside the document are ignored.
    """
    key = ["job_id", "page_number"]
    open_jobs = jobs.where(F.col("status").isin("queued", "running")).select("job_id", "num_pages")
    wanted = (
        attach(requests.select(*key).distinct(), open_jobs, ["job_id"], "inner")
        .where(F.col("page_number").between(1, F.col("num_pages")))
        .select(*key, F.lit(True).alias("_asked"))
    )
    joined = job_pages.join(wanted, key, "full_outer")
    moved = F.coalesce(F.col("_asked"), F.lit(False)) & ~F.col("status").eqNullSafe("running")
    changed = {
        "priority": F.when(moved, F.lit(TOP_PRIORITY)).otherwise(F.col("priority")),
        "status": F.when(moved, "queued").otherwise(F.col("status")),
        **{c: F.when(~moved, F.col(c)) for c in ("error", "started_at", "finished_at") if c in job_pages.columns},
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in job_pages.columns])


def retry_failed(jobs: DataFrame, job_pages: DataFrame) -> DataFrame:
    """Fresh queue rows for the failed and cancelled pages of finished jobs."""
    finished = jobs.where(~F.col("status").isin(*ACTIVE_JOB)).select("job_id")
    unfinished = job_pages.where(F.col("status").isin("failed", "cancelled"))
    return attach(unfinished, finished, ["job_id"], "left_semi").select(
        "job_id", "page_number", F.lit("queued").alias("status"), F.lit(0).alias("attempts")
    )


def _cancelled(job_status: Column, requested: Column) -> Column:
    return (job_status == "cancelling") | (job_status.isin("queued", "running") & requested)


def recover_interrupted(jobs: DataFrame) -> DataFrame:
    """Job table after a restart: cancellations complete, other open jobs queue again."""
    status, requested = F.col("status"), F.col("cancel_requested")
    return jobs.withColumn(
        "status",
        F.when(_cancelled(status, requested), "cancelled")
        .when(status.isin("queued", "running"), "queued")
        .otherwise(status),
    )


def recover_interrupted_pages(jobs: DataFrame, job_pages: DataFrame) -> DataFrame:
    """Job pages after a restart, given the job table from before it."""
    state = jobs.select(
        "job_id",
        ((F.col("status") == "cancelling") | F.col("cancel_requested")).alias("_cancel"),
        (F.col("status").isin("queued", "running") & ~F.col("cancel_requested")).alias("_resume"),
    )
    status = F.col("status")
    stop = F.coalesce("_cancel", F.lit(False)) & status.isin("queued", "running")
    resume = F.coalesce("_resume", F.lit(False)) & (status == "running")
    error = (
        F.when(stop, F.coalesce("error", F.lit("Cancelled before application restart")))
        .when(resume, "Resumed after application restart")
        .otherwise(F.col("error"))
    )
    return (
        attach(job_pages, state, ["job_id"])
        .withColumn("error", error)
        .withColumn("status", F.when(stop, "cancelled").when(resume, "queued").otherwise(status))
        .drop("_cancel", "_resume")
    )


def cancel_jobs(jobs: DataFrame, cancels: DataFrame) -> DataFrame:
    """Open jobs named by ``cancels`` turn cancelling."""
    asked = cancels.select("job_id").distinct().withColumn("_asked", F.lit(True))
    hit = F.coalesce("_asked", F.lit(False))
    return (
        jobs.join(asked, "job_id", "left")
        .withColumn("cancel_requested", F.col("cancel_requested") | hit)
        .withColumn(
            "status",
            F.when(hit & F.col("status").isin("queued", "running"), "cancelling").otherwise(F.col("status")),
        )
        .drop("_asked")
    )


def finish_cancelled_pages(jobs: DataFrame, job_pages: DataFrame) -> DataFrame:
    """Queued pages of cancelling jobs become cancelled."""
    stopping = jobs.where(F.col("status") == "cancelling").select("job_id").withColumn("_stop", F.lit(True))
    stop = F.coalesce("_stop", F.lit(False)) & (F.col("status") == "queued")
    return attach(job_pages, stopping, ["job_id"]).withColumn(
        "status", F.when(stop, "cancelled").otherwise(F.col("status"))
    ).drop("_stop")


def mark_pages(job_pages: DataFrame, events: DataFrame) -> DataFrame:
    """Job pages after all status events (``status``, ``duration_ms``, ``ts``, ``event_id``).

    The last event decides status and error, durations keep the last known value, each start
    counts as an attempt, and times follow the last start and the last end. Where the tables have
    them, a start also sets ``priority`` to 0, ``error_code`` follows the last event, and
    ``processing_mode`` and ``remote_batch_id`` keep the last value that an event gives.
    """
    key = ["job_id", "page_number"]
    order = F.struct("ts", "event_id")
    status, ts = F.col("status"), F.col("ts")
    running, ended = status == "running", status.isin(*_TERMINAL_PAGE)
    summary = events.groupBy(*key).agg(
        F.max_by("status", order).alias("_status"),
        F.max_by("error", order).alias("_error"),
        F.max_by("duration_ms", F.when(F.col("duration_ms").isNotNull(), order)).alias("_duration"),
        F.count_if(running).alias("_starts"),
        F.max(F.when(running, ts)).alias("_started"),
        F.max(F.when(ended, ts)).alias("_finished"),
        *[F.max_by(c, order).alias(f"_{c}") for c in ("error_code",) if c in events.columns],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in _GIVEN if c in events.columns],
    )
    hit = F.col("_status").isNotNull()
    more = []
    if "priority" in job_pages.columns:
        more.append(F.when(F.coalesce("_starts", F.lit(0)) > 0, 0).otherwise(F.col("priority")).alias("priority"))
    if "error_code" in job_pages.columns and "error_code" in events.columns:
        more.append(F.when(hit, F.col("_error_code")).otherwise(F.col("error_code")).alias("error_code"))
    more += [F.coalesce(f"_{c}", c).alias(c) for c in _GIVEN if c in job_pages.columns and c in events.columns]
    return job_pages.join(summary, key, "left").select(
        *key,
        F.coalesce("_status", "status").alias("status"),
        F.when(hit, F.col("_error")).otherwise(F.col("error")).alias("error"),
        F.coalesce("_duration", "duration_ms").alias("duration_ms"),
        (F.col("attempts") + F.coalesce("_starts", F.lit(0))).alias("attempts"),
        F.coalesce("_started", "started_at").alias("started_at"),
        F.coalesce("_finished", "finished_at").alias("finished_at"),
        *more,
    )


def start_jobs(jobs: DataFrame, started: DataFrame) -> DataFrame:
    """Queued jobs named by ``started`` turn running and get the first ``started_at`` given there."""
    asked = started.where("job_id IS NOT NULL").groupBy("job_id").agg(F.min("started_at").alias("_at"), F.lit(True).alias("_started"))
    starts = F.coalesce("_started", F.lit(False)) & (F.col("status") == "queued")
    return (
        attach(jobs, asked, ["job_id"])
        .withColumn("started_at", F.when(starts, F.col("_at")).otherwise(F.col("started_at")))
        .withColumn("status", F.when(starts, "running").otherwise(F.col("status")))
        .drop("_started", "_at")
    )


def classify_errors(df: DataFrame, status: str = "status_code", message: str = "error") -> DataFrame:
    """Adds ``error_code``, ``retryable`` and ``rate_limited``; the first matching rule wins."""
    code = F.col(status)
    text = F.lower(F.coalesce(F.col(message), F.lit("")))
    limited = (code == 429) | text.contains("rate limit") | text.contains("too many requests")
    upstream = code.between(500, 599)
    transient = text.rlike("timed out|timeout|connection reset|temporarily unavailable")
    request = code.between(400, 499)
    error_code = (
        F.when(limited, "rate_limited")
        .when(upstream, F.concat(F.lit("upstream_"), code.cast("string")))
        .when(transient, "transient_network")
        .when(request, F.concat(F.lit("request_"), code.cast("string")))
        .otherwise("ocr_error")
    )
    no = F.lit(False)
    return (
        df.withColumn("error_code", error_code)
        .withColumn("retryable", F.coalesce(limited, no) | F.coalesce(upstream, no) | transient)
        .withColumn("rate_limited", F.coalesce(limited, no))
    )


def retry_plan(df: DataFrame, max_attempts: int = MAX_ATTEMPTS, jitter: bool = False) -> DataFrame:
    """Adds ``retry`` and ``delay_seconds``: the server's delay, else capped doubling from 0.5 s."""
    backoff = F.least(F.lit(8.0), F.lit(0.5) * F.pow(F.lit(2.0), F.col("attempt") - 1))
    if jitter:
        backoff = backoff + F.rand() * 0.25
    server = F.when(F.col("retry_after").isNotNull(), F.greatest(F.lit(0.0), F.col("retry_after")))
    retry = F.col("retryable") & (F.col("attempt") < max_attempts)
    return df.withColumn("retry", retry).withColumn(
        "delay_seconds", F.when(F.col("retry"), F.coalesce(server, backoff))
    )


def job_eta(
    jobs: DataFrame, limit: float = 1250.0, utilization: float = 0.88, batch_min_pages: int = 500
) -> DataFrame:
    """Adds predicted real-time and batch seconds and the faster ``mode`` of each job.

    Jobs carry pending_pages, concurrency, latency, observed_rate and batch_seconds_per_page;
    unknown latency counts as five seconds.
    """
    latency = F.greatest(F.lit(0.05), F.coalesce(F.nullif("latency", F.lit(0.0)), F.lit(5.0)))
    by_limit = F.least(
        F.lit(limit * utilization / 60.0), F.greatest(F.lit(1), F.col("concurrency")) / latency
    )
    rate = F.least(by_limit, F.coalesce(F.nullif("observed_rate", F.lit(0.0)), by_limit))
    realtime = F.col("pending_pages") / F.greatest(F.lit(0.01), rate)
    batch = 5.0 + F.col("pending_pages") * F.col("batch_seconds_per_page")
    use_batch = (F.col("pending_pages") >= batch_min_pages) & (batch < realtime * 0.9)
    return (
        jobs.withColumn("realtime_seconds", realtime)
        .withColumn("batch_seconds", batch)
        .withColumn("mode", F.when(F.coalesce(use_batch, F.lit(False)), "batch").otherwise("realtime"))
    )
