"""Streaming queries, drained to completion and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans.job_queries import _ewma_sql
from quire.plans.registry import bind_stream, query
from quire.plans.text_queries import _STATS
from quire.session import stream_table, table, work_dir
from quire.streaming import streams


def _timed(stream):
    """Watermarks need zoned timestamps; the tables carry plain ones."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_latest_status",
    """
    SELECT job_id, page_number, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts,
           arg_max(event_id, (ts, event_id)) AS event_id
    FROM [[status_events]] GROUP BY job_id, page_number
    """,
)
def _(spark, root):
    events = bind_stream(spark, root, "status_events")
    return streams.stream_latest_status(spark, events, work_dir(spark, "latest-status"))


@query(
    "stream_claims",
    """
    SELECT document_id, page_number, owner_token, claimed_at FROM (
      SELECT *, row_number() OVER (PARTITION BY document_id, page_number, time_bucket(INTERVAL 10 MINUTES, claimed_at)
                                   ORDER BY claimed_at, owner_token) AS n
      FROM (SELECT document_id, page_number, owner_token, CAST(claimed_at AS TIMESTAMP) AS claimed_at FROM [[claims]]))
    WHERE n = 1
    """,
)
def _(spark, root):
    claims = bind_stream(spark, root, "claims").withColumn("claimed_at", F.col("claimed_at").cast("timestamp"))
    first = streams.stream_claims(spark, claims, work_dir(spark, "claims"), "10 minutes")
    return first.select("document_id", "page_number", "owner_token", F.col("claimed_at").cast("timestamp_ntz").alias("claimed_at"))


@query(
    "stream_rate_windows",
    """
    SELECT date_trunc('minute', ts) AS window_start, count(*) AS pages, count(*) > 1100 AS over_target
    FROM [[job_pages]] GROUP BY window_start
    """,
)
def _(spark, root):
    pages = _timed(bind_stream(spark, root, "job_pages"))
    closed = streams.stream_rate_windows(spark, pages, work_dir(spark, "rate"))
    return closed.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "pages", "over_target")


@query("stream_latency_ewma", _ewma_sql("job_id", "8e-1", "2e-1"))
def _(spark, root):
    samples = bind_stream(spark, root, "job_pages").select("job_id", "duration_seconds", "ts", "event_id")
    ewma = streams.stream_latency_ewma(
        spark, samples, work_dir(spark, "ewma"), "job_id", "duration_seconds"
    )
    return ewma.withColumn("ewma", F.round("ewma", 6))


@query(
    "stream_job_progress",
    """
    SELECT job_id, CAST(count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) AS BIGINT) AS done, count(*) AS total
    FROM (SELECT job_id, page_number, arg_max(status, (ts, event_id)) AS status FROM [[status_events]] GROUP BY job_id, page_number)
    GROUP BY job_id
    """,
)
def _(spark, root):
    return streams.stream_job_progress(
        spark, bind_stream(spark, root, "status_events"), work_dir(spark, "progress")
    )


@query(
    "stream_index_update",
    f"""
    WITH {_STATS.replace('[[doc_pages]]', '[[page_table]]')}
    SELECT token, document_id, page_number, CAST(count(*) AS INTEGER) AS tf, CAST(max(dl) AS INTEGER) AS dl
    FROM p GROUP BY token, document_id, page_number
    """,
)
def _(spark, root):
    changes = bind_stream(spark, root, "page_table").select("document_id", "page_number", "markdown")
    return streams.stream_index_update(spark, changes, work_dir(spark, "index")).select(
        "token", "document_id", "page_number", "tf", "dl"
    )


@query(
    "stream_reject_stale",
    """
    SELECT document_id, expected_checksum, job_id,
           CASE WHEN expected_checksum = 'outdated' THEN 'content_changed'
                WHEN job_id IN (SELECT source FROM {documents} GROUP BY source HAVING min(doc_id) % 3 = 0)
                THEN 'job_cancelled' END AS reject_reason
    FROM (SELECT document_id, session_id AS job_id,
                 CASE n_chars % 3 WHEN 0 THEN checksum WHEN 1 THEN 'outdated' END AS expected_checksum FROM [[doc_table]])
    """,
)
def _(spark, root):
    third = F.col("n_chars") % 3
    results = bind_stream(spark, root, "doc_table").select(
        "document_id", F.col("session_id").alias("job_id"),
        F.when(third == 0, F.col("checksum")).when(third == 1, "outdated").alias("expected_checksum"),
    )
    stored = work_dir(spark, "checksums")  # once, not in every batch
    table(spark, root, "documents").select(
        F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("checksum")
    ).write.parquet(stored)
    documents = spark.read.parquet(stored)
    cancelled = (
        table(spark, root, "documents").groupBy(F.col("source").alias("job_id"))
        .agg(F.min("doc_id").alias("first")).where("first % 3 = 0")
    )
    accepted, rejected = streams.stream_reject_stale(
        spark, results, documents, work_dir(spark, "stale"), cancelled
    )
    columns = ["document_id", "expected_checksum", "job_id", "reject_reason"]
    return accepted.withColumn("reject_reason", F.lit(None).cast("string")).select(*columns).union(
        rejected.select(*columns)
    )


@query("stream_ingest_files", "SELECT 'events.parquet' AS file_name, count(*) AS file_rows FROM {events}")
def _(spark, root):
    stream = stream_table(spark, root, "events", maxFilesPerTrigger=64)
    return streams.stream_ingest_files(spark, stream, work_dir(spark, "ingest")).select("file_name", "file_rows")
