"""Queries over jobs and their pages: roll-ups, windows, claims, state transitions, user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.ranking import minute_of, page_block
from quire.operators import aggregates, transitions, userfuncs, windows
from quire.operators.selection import job_recoverable
from quire.plans.registry import bind, query
from quire.session import table, work_dir
from quire.sources.buckets import create_table


_ROLLUP = """
    SELECT job_id, count(*) AS total_pages,
           CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed_pages,
           CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed_pages,
           CAST(count(*) FILTER (status = 'cancelled') AS BIGINT) AS cancelled_pages,
           CAST(min(page_number) FILTER (status = 'running') AS VARCHAR) AS current_page
    FROM [[job_pages]] GROUP BY job_id
"""


@query("job_rollup", _ROLLUP)
def _(spark, root):
    rolled = aggregates.job_rollup(bind(spark, root, "job_pages"))
    return rolled.withColumn("current_page", F.col("current_page").cast("string"))


@query(
    "job_recoverable",
    f"""
    SELECT r.job_id, j.status,
           j.status IN ('failed', 'interrupted', 'cancelled') AND r.failed_pages + r.cancelled_pages > 0 AS recoverable,
           CAST(floor((r.completed_pages + r.failed_pages + r.cancelled_pages) * 100e0 / r.total_pages + 5e-1) AS INTEGER) AS percent
    FROM ({_ROLLUP}) r JOIN [[jobs]] j ON r.job_id = j.job_id
    """,
)
def _(spark, root):
    rolled = aggregates.job_rollup(bind(spark, root, "job_pages"))
    jobs = bind(spark, root, "jobs").select("job_id", "status")
    return job_recoverable(rolled.join(jobs, "job_id")).select("job_id", "status", "recoverable", "percent")


@query(
    "document_page_lists",
    """
    SELECT document_id, CAST((page_number - 1) // 4096 AS BIGINT) AS block,
           string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) AS completed_pages,
           coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number)
                    FILTER (review_status = 'approved'), '') AS approved_pages,
           coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number)
                    FILTER (review_status = 'needs_review'), '') AS needs_review_pages
    FROM [[page_table]] GROUP BY document_id, block
    """,
)
def _(spark, root):
    lists = aggregates.document_page_lists(bind(spark, root, "page_table"))
    return lists.select(
        "document_id", "block",
        *[F.array_join(c, ",").alias(c) for c in ("completed_pages", "approved_pages", "needs_review_pages")],
    )


@query("ocr_page_count", "SELECT document_id, count(*) AS ocr_pages FROM [[page_table]] GROUP BY document_id")
def _(spark, root):
    return aggregates.ocr_page_count(bind(spark, root, "page_table"))


@query(
    "assign_sort_order",
    """
    WITH top AS (SELECT source, max(doc_id % 100) AS m FROM {documents} WHERE lang <> 'en' GROUP BY source)
    SELECT d.doc_id, d.source,
           CAST(coalesce(t.m, -1) + row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS BIGINT) AS sort_order
    FROM {documents} d LEFT JOIN top t ON d.source = t.source
    """,
)
def _(spark, root):
    documents = table(spark, root, "documents").select("doc_id", "source", "lang")
    existing = documents.where("lang <> 'en'").withColumn("sort_order", F.col("doc_id") % 100)
    return aggregates.assign_sort_order(
        existing, documents.drop("lang"), "source", page_block(F.col("doc_id")), [F.asc("doc_id")]
    )


@query(
    "finalize_jobs",
    """
    WITH g AS (SELECT l_orderkey AS job_id,
                      CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'cancelled' ELSE 'completed' END AS status,
                      l_linestatus = 'O' AND l_quantity > 45 AS open FROM {lineitem})
    SELECT job_id, CASE WHEN count(*) FILTER (status = 'failed' AND NOT open) > 0 THEN 'failed' ELSE 'completed' END AS status,
           CASE WHEN count(*) FILTER (status = 'failed' AND NOT open) > 0
                THEN concat(count(*) FILTER (status = 'failed' AND NOT open), ' page(s) failed') END AS error
    FROM g GROUP BY job_id HAVING count(*) FILTER (open) = 0
    """,
)
def _(spark, root):
    flag = F.col("l_returnflag")
    lines = table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), "running")
        .when(flag == "R", "failed").when(flag == "A", "cancelled").otherwise("completed").alias("status"),
    )
    return aggregates.finalize_jobs(lines)


@query(
    "throughput_report",
    """
    WITH m AS (
      SELECT processing_mode, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed_pages,
             CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed_pages,
             (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS sec FROM [[job_pages]] GROUP BY processing_mode)
    SELECT processing_mode, completed_pages, failed_pages, round(sec, 3) AS elapsed_seconds,
           round(completed_pages * 60e0 / greatest(1e-3, sec), 2) AS pages_per_minute,
           round(completed_pages * 60e0 / greatest(1e-3, sec) / 11e2 * 100, 2) AS target_percent,
           (SELECT arg_min(processing_mode, sec) FROM m) AS faster_mode,
           round((SELECT max(sec) FROM m WHERE processing_mode = 'realtime')
                 / greatest(1e-3, (SELECT max(sec) FROM m WHERE processing_mode = 'batch')), 3) AS speed_ratio
    FROM m
    """,
)
def _(spark, root):
    return aggregates.throughput_report(bind(spark, root, "job_pages"))


def _ewma_sql(key: str, keep: str, rest: str) -> str:
    return f"""
    SELECT {key}, round(list_reduce(list_prepend(v[1], v[2:]), lambda acc, x: acc * {keep} + x * {rest}), 6) AS ewma,
           CAST(len(v) AS BIGINT) AS samples
    FROM (SELECT {key}, list(duration_seconds ORDER BY ts, event_id) AS v FROM [[job_pages]]
          WHERE duration_seconds > 0 GROUP BY {key})
    """


def _newest():
    return [F.desc("ts"), F.desc("event_id")]


@query("latency_ewma", _ewma_sql("job_id", "8e-1", "2e-1"))
def _(spark, root):
    samples = bind(spark, root, "job_pages").select("job_id", "duration_seconds", "ts", "event_id")
    ewma = aggregates.latency_ewma(samples, "job_id", "duration_seconds", minute_of(F.col("ts")), _newest())
    return ewma.withColumn("ewma", F.round("ewma", 6))


@query("batch_latency_ewma", _ewma_sql("processing_mode", "7e-1", "3e-1"))
def _(spark, root):
    """The batch weights, over one key per mode: each holds half of all rows."""
    samples = bind(spark, root, "job_pages").select("processing_mode", "duration_seconds", "ts", "event_id")
    ewma = aggregates.latency_ewma(
        samples, "processing_mode", "duration_seconds", minute_of(F.col("ts")), _newest(), keep=0.7
    )
    return ewma.withColumn("ewma", F.round("ewma", 6))


@query(
    "dedup_checksum",
    """
    SELECT session_id, checksum, min(document_id) AS document_id, count(*) AS copies FROM [[doc_table]]
    GROUP BY session_id, checksum
    """,
)
def _(spark, root):
    return aggregates.dedup_checksum(bind(spark, root, "doc_table"))


@query(
    "dedup_checksum_corpus",
    """
    SELECT substr(sha1(content), 1, 12) AS content_id, min(document_id) AS document_id, count(*) AS copies
    FROM [[doc_table]] GROUP BY content_id
    """,
)
def _(spark, root):
    documents = bind(spark, root, "doc_table").select(
        "document_id", aggregates.short_content_id(F.col("content")).alias("content_id")
    )
    return aggregates.dedup_checksum(documents, ["content_id"])


_WORDS = "CASE WHEN trim({0}, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE len(regexp_split_to_array(trim({0}, ' ' || chr(9) || chr(10) || chr(13)), '\\s+')) END"


@query(
    "word_counts",
    f"""
    SELECT document_id, CAST(sum({_WORDS.format('markdown')}) AS BIGINT) AS words, count(*) AS pages
    FROM (SELECT document_id, markdown FROM [[page_table]]
          UNION ALL SELECT document_id, markdown FROM [[doc_pages]]) GROUP BY document_id
    """,
)
def _(spark, root):
    pages = bind(spark, root, "page_table").select("document_id", "markdown")
    documents = bind(spark, root, "doc_pages", heavy=True).select("document_id", "markdown")
    return aggregates.word_counts(pages.union(documents))


@query("page_word_counts", f"SELECT document_id, page_number, CAST({_WORDS.format('markdown')} AS INTEGER) AS words FROM [[doc_pages]]")
def _(spark, root):
    return aggregates.page_word_counts(bind(spark, root, "doc_pages", heavy=True))


@query(
    "scheduler_snapshot",
    f"""
    WITH e AS ({_ewma_sql("processing_mode", "8e-1", "2e-1")})
    SELECT p.processing_mode, 1250 AS pages_per_minute_limit, 1100 AS target_pages_per_minute,
           CAST(count(*) FILTER (duration_seconds > 0) AS BIGINT) AS samples,
           CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS rate_limit_events,
           arg_max(status, (ts, event_id)) AS last_status, round(max(e.ewma), 3) AS average_page_seconds
    FROM [[job_pages]] p JOIN e ON p.processing_mode = e.processing_mode GROUP BY p.processing_mode
    """,
)
def _(spark, root):
    pages = bind(spark, root, "job_pages").withColumn("rate_limited", F.col("status") == "failed")
    ewma = aggregates.latency_ewma(
        pages.select("processing_mode", "duration_seconds", "ts", "event_id"),
        "processing_mode", "duration_seconds", minute_of(F.col("ts")), _newest(),
    )
    return aggregates.scheduler_snapshot(pages, ewma)


@query(
    "next_pages",
    """
    SELECT job_id, page_number, priority, position FROM (
      SELECT job_id, page_number, priority,
             CAST(row_number() OVER (PARTITION BY job_id ORDER BY priority DESC, page_number) AS INTEGER) AS position
      FROM [[job_pages]] WHERE status = 'queued') WHERE position <= 3
    """,
)
def _(spark, root):
    return windows.next_pages(bind(spark, root, "job_pages"), 3).select(
        "job_id", "page_number", "priority", "position"
    )


@query(
    "resolve_claims",
    """
    SELECT document_id, page_number, owner_token, claimed_at, price,
           CASE WHEN row_number() OVER (PARTITION BY document_id, page_number
                                        ORDER BY claimed_at, owner_token, price) = 1
                THEN 'won' ELSE 'duplicate_claim' END AS outcome
    FROM [[claims]]
    """,
)
def _(spark, root):
    return windows.resolve_claims(
        bind(spark, root, "claims"), ["document_id", "page_number"], ["claimed_at", "owner_token", "price"]
    )


@query(
    "release_claims",
    """
    SELECT document_id, page_number, owner_token FROM [[claims]] c
    WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_returnflag = 'R' AND l.l_orderkey = c.document_id
      AND l.l_linenumber = c.page_number AND concat(l.l_partkey, '-', l.l_suppkey) = c.owner_token)
    """,
)
def _(spark, root):
    releases = table(spark, root, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("owner_token"),
    )
    held = bind(spark, root, "claims").select("document_id", "page_number", "owner_token")
    return windows.release_claims(held, releases, ["document_id", "page_number"])


_LATEST = """
    SELECT document_id, arg_max(job_id, (created_at, job_id)) AS job_id, arg_max(status, (created_at, job_id)) AS status,
           max(created_at) AS created_at FROM [[order_jobs]] {} GROUP BY document_id
"""


@query("latest_job", _LATEST.format(""))
def _(spark, root):
    return windows.latest_job(bind(spark, root, "order_jobs"))


@query("active_job", _LATEST.format("WHERE status IN ('queued', 'running', 'cancelling')"))
def _(spark, root):
    return windows.active_job(bind(spark, root, "order_jobs"))


@query(
    "micro_batches",
    """
    SELECT job_id, page_number, CAST((row_number() OVER (PARTITION BY job_id ORDER BY priority DESC, page_number) - 1) // 8
           AS BIGINT) AS batch_number FROM [[job_pages]] WHERE status = 'queued'
    """,
)
def _(spark, root):
    return windows.micro_batches(bind(spark, root, "job_pages")).select("job_id", "page_number", "batch_number")


@query(
    "throughput_windows",
    """
    WITH n AS (SELECT processing_mode, ts, (row_number() OVER (PARTITION BY processing_mode ORDER BY ts, event_id) - 1) // 8
                      AS window_number FROM [[job_pages]] WHERE status = 'completed'),
    w AS (SELECT processing_mode, window_number, count(*) AS pages, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS sec
          FROM n GROUP BY processing_mode, window_number HAVING count(*) = 8),
    r AS (SELECT *, pages / greatest(1e-3, sec) AS pps FROM w)
    SELECT processing_mode, CAST(window_number AS BIGINT) AS window_number, pages, round(sec, 6) AS elapsed_seconds,
           round(pps, 6) AS pages_per_second,
           coalesce(pps >= lag(pps) OVER (PARTITION BY processing_mode ORDER BY window_number) * 105e-2, true) AS improved
    FROM r
    """,
)
def _(spark, root):
    samples = bind(spark, root, "job_pages").where("status = 'completed'").select(
        "processing_mode", "ts", "event_id"
    )
    return windows.throughput_windows(
        samples, "processing_mode", minute_of(F.col("ts")), [F.asc("ts"), F.asc("event_id")]
    )


_UPSERT_PAGES = """
    WITH old AS (
      SELECT document_id, page_number, markdown AS source_markdown, concat(markdown, ' edited') AS markdown,
             '{{"version":1}}' AS preprocessing_json, confidence_score, review_status,
             CASE WHEN review_status = 'approved' THEN 'day one' END AS reviewed_at FROM [[page_table]]),
    new AS (
      SELECT d.document_id, 1 AS page_number, CASE WHEN l.doc_id IS NOT NULL THEN d.content END AS source_markdown,
             d.content AS markdown, '{{"version":2}}' AS preprocessing_json, (d.n_chars % 100) / 100e0 AS confidence_score
      FROM [[doc_table]] d LEFT JOIN {labels} l ON l.doc_id = d.document_id)
    SELECT coalesce(n.document_id, o.document_id) AS document_id,
           CAST(coalesce(n.page_number, o.page_number) AS INTEGER) AS page_number,
           coalesce(n.source_markdown, o.source_markdown) AS source_markdown,
           CASE WHEN n.document_id IS NOT NULL THEN n.markdown ELSE o.markdown END AS markdown,
           CASE WHEN n.source_markdown IS NOT NULL THEN n.preprocessing_json ELSE o.preprocessing_json END AS preprocessing_json,
           CASE WHEN n.source_markdown IS NOT NULL THEN n.confidence_score ELSE o.confidence_score END AS confidence_score,
           CASE WHEN n.document_id IS NULL THEN o.review_status
                WHEN n.source_markdown IS NOT NULL AND (trim(n.markdown) = '' OR n.confidence_score < 8e-1) THEN 'needs_review'
                ELSE 'unreviewed' END AS review_status,
           CASE WHEN n.document_id IS NULL THEN o.reviewed_at END AS reviewed_at
    FROM old o FULL OUTER JOIN new n ON o.document_id = n.document_id AND o.page_number = n.page_number
    """.replace("{{", "{").replace("}}", "}")


def _page_versions(spark, root):
    """A page table, and OCR results and edits for it."""
    old = bind(spark, root, "page_table").select(
        "document_id", "page_number", F.col("markdown").alias("source_markdown"),
        F.concat("markdown", F.lit(" edited")).alias("markdown"),
        F.lit('{"version":1}').alias("preprocessing_json"), "confidence_score", "review_status",
        F.when(F.col("review_status") == "approved", "day one").alias("reviewed_at"),
    )
    labelled = table(spark, root, "labels").select(F.col("doc_id").alias("document_id"), F.lit(True).alias("ocr"))
    new = bind(spark, root, "doc_table").join(labelled, "document_id", "left").select(
        "document_id", F.lit(1).alias("page_number"),
        F.when(F.col("ocr"), F.col("content")).alias("source_markdown"), F.col("content").alias("markdown"),
        F.lit('{"version":2}').alias("preprocessing_json"),
        ((F.col("n_chars") % 100) / F.lit(100.0)).alias("confidence_score"),
    )
    return old, new


@query("upsert_pages", _UPSERT_PAGES)
def _(spark, root):
    return transitions.upsert_pages(*_page_versions(spark, root))


@query("upsert_pages_stored", _UPSERT_PAGES)
def _(spark, root):
    """The same in a stored table, whose buckets two batches of changes rewrite one after the other."""
    old, new = _page_versions(spark, root)
    stored = create_table(old, work_dir(spark, "pages"), ["document_id"], 32)
    for batch in (0, 1):
        part = new.where(F.pmod(F.xxhash64("document_id"), F.lit(2)) == batch)
        stored = stored.update(part, batch, transitions.upsert_pages)
    return stored.read()


@query(
    "initial_review_status",
    """
    SELECT document_id, page_number,
           CASE WHEN review_status <> 'unreviewed' AND (trim(markdown) = '' OR confidence_score < 8e-1)
                THEN 'needs_review' ELSE 'unreviewed' END AS status
    FROM [[review_pages]]
    """,
)
def _(spark, root):
    status = transitions.initial_review_status(
        F.col("markdown"), F.col("confidence_score"), F.col("review_status") != "unreviewed"
    )
    return bind(spark, root, "review_pages").select("document_id", "page_number", status.alias("status"))


@query(
    "replace_page_assets",
    """
    WITH new AS (SELECT doc_id AS document_id, 1 AS page_number, concat('new-', doc_id, '.png') AS filename FROM {labels})
    SELECT document_id, page_number, filename FROM [[assets]]
    WHERE document_id NOT IN (SELECT document_id FROM new)
    UNION ALL SELECT document_id, page_number, filename FROM new
    """,
)
def _(spark, root):
    old = bind(spark, root, "assets").select("document_id", "page_number", "filename")
    new = table(spark, root, "labels").select(
        F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"),
        F.concat(F.lit("new-"), F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"),
    )
    return transitions.replace_page_assets(old, new)


_REVIEWS = """
    SELECT doc_id AS document_id, 1 AS page_number,
           CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 1 THEN 'approved' ELSE 'needs_review' END AS status,
           'day two' AS at FROM {labels}
    UNION ALL SELECT -1 - item_id, 1, 'approved', 'day two' FROM {benchmark}
"""


def _reviews(spark, root):
    return spark.sql(_REVIEWS, labels=table(spark, root, "labels"), benchmark=table(spark, root, "benchmark"))


@query(
    "apply_reviews",
    f"""
    SELECT p.document_id, p.page_number,
           CASE WHEN r.status IN ('approved', 'needs_review') THEN r.status ELSE 'unreviewed' END AS review_status,
           CASE WHEN r.status = 'approved' THEN r.at WHEN r.status = 'needs_review' THEN NULL ELSE 'day one' END AS reviewed_at
    FROM [[doc_pages]] p LEFT JOIN ({_REVIEWS}) r ON p.document_id = r.document_id
    """,
)
def _(spark, root):
    pages = bind(spark, root, "doc_pages").select(
        "document_id", "page_number", F.lit("unreviewed").alias("review_status"), F.lit("day one").alias("reviewed_at")
    )
    return transitions.apply_reviews(pages, _reviews(spark, root))


@query(
    "rejected_reviews",
    f"""
    SELECT document_id, page_number, status,
           CASE WHEN status = 'flagged' THEN 'unknown_status' ELSE 'page_missing' END AS reason
    FROM ({_REVIEWS}) WHERE status = 'flagged' OR document_id NOT IN (SELECT doc_id FROM {{documents}})
    """,
)
def _(spark, root):
    return transitions.rejected_reviews(bind(spark, root, "doc_pages"), _reviews(spark, root)).drop("at")


@query(
    "upsert_extractions",
    """
    WITH old AS (SELECT o_orderkey AS document_id, 'invoice' AS profile, o_orderpriority AS data_json, 'approved' AS status,
                        o_orderdate AS created_at FROM {orders}),
    new AS (SELECT l_orderkey AS document_id, CASE WHEN l_orderkey % 3 = 0 THEN 'receipt' ELSE 'invoice' END AS profile,
                   CAST(sum(l_linenumber) AS VARCHAR) AS data_json,
                   CASE WHEN max(l_returnflag) = 'R' THEN 'approved' ELSE 'needs_review' END AS status,
                   max(l_shipdate) AS at FROM {lineitem} GROUP BY l_orderkey)
    SELECT coalesce(n.document_id, o.document_id) AS document_id, coalesce(n.profile, o.profile) AS profile,
           coalesce(n.data_json, o.data_json) AS data_json,
           CAST(CASE WHEN n.document_id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS schema_version,
           coalesce(n.status, o.status) AS status, 'model' AS model,
           CASE WHEN n.document_id IS NULL THEN o.created_at WHEN n.status = 'approved' THEN n.at END AS reviewed_at,
           coalesce(o.created_at, n.at) AS created_at
    FROM old o FULL OUTER JOIN new n ON o.document_id = n.document_id AND o.profile = n.profile
    """,
)
def _(spark, root):
    old = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.lit("invoice").alias("profile"),
        F.col("o_orderpriority").alias("data_json"), F.lit(1).alias("schema_version"),
        F.lit("approved").alias("status"), F.lit("model").alias("model"),
        F.col("o_orderdate").alias("reviewed_at"), F.col("o_orderdate").alias("created_at"),
    )
    new = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(
        F.sum("l_linenumber").cast("string").alias("data_json"),
        F.when(F.max("l_returnflag") == "R", "approved").otherwise("needs_review").alias("status"),
        F.max("l_shipdate").alias("at"),
    ).withColumns({
        "profile": F.when(F.col("document_id") % 3 == 0, "receipt").otherwise("invoice"),
        "schema_version": F.lit(2), "model": F.lit("model"),
    })
    return transitions.upsert_extractions(old, new)


@query(
    "create_jobs",
    """
    WITH w AS (SELECT document_id, unnest(range(1, num_pages + 1)) AS page_number FROM [[page_docs]])
    SELECT concat('job-', w.document_id) AS job_id, w.document_id, CAST(w.page_number AS INTEGER) AS page_number,
           CASE WHEN p.document_id IS NULL THEN 'queued' ELSE 'completed' END AS status
    FROM w LEFT JOIN [[page_table]] p ON w.document_id = p.document_id AND w.page_number = p.page_number
    """,
)
def _(spark, root):
    documents = bind(spark, root, "page_docs").withColumn(
        "job_id", F.concat(F.lit("job-"), F.col("document_id").cast("string"))
    )
    return transitions.create_jobs(documents, bind(spark, root, "page_table")).select(
        "job_id", "document_id", "page_number", "status"
    )


@query(
    "new_job_rows",
    """
    SELECT concat('job-', document_id) AS job_id, document_id, 'queued' AS status, 'adaptive' AS processing_mode,
           false AS force_reprocess, false AS cancel_requested, checksum AS document_checksum,
           CAST(1250 AS INTEGER) AS rate_limit_ppm
    FROM [[doc_table]]
    """,
)
def _(spark, root):
    documents = bind(spark, root, "doc_table").withColumn(
        "job_id", F.concat(F.lit("job-"), F.col("document_id").cast("string"))
    )
    return transitions.new_job_rows(documents)


@query(
    "prioritize_pages",
    """
    WITH asked AS (
      SELECT DISTINCT e.job_id, e.page_number FROM (
        SELECT job_id, page_number FROM [[status_events]] UNION ALL
        SELECT job_id, page_number * 2 FROM [[job_pages]]) e
      JOIN [[jobs]] j ON e.job_id = j.job_id AND j.status IN ('queued', 'running')
      WHERE e.page_number BETWEEN 1 AND j.num_pages)
    SELECT coalesce(p.job_id, a.job_id) AS job_id, coalesce(p.page_number, a.page_number) AS page_number,
           CAST(CASE WHEN a.job_id IS NOT NULL AND coalesce(p.status, '') <> 'running' THEN 1000 ELSE p.priority END AS INTEGER) AS priority,
           CASE WHEN a.job_id IS NOT NULL AND coalesce(p.status, '') <> 'running' THEN 'queued' ELSE p.status END AS status
    FROM [[job_pages]] p FULL OUTER JOIN asked a ON p.job_id = a.job_id AND p.page_number = a.page_number
    """,
)
def _(spark, root):
    pages = bind(spark, root, "job_pages").select("job_id", "page_number", "priority", "status")
    requests = bind(spark, root, "status_events").select("job_id", F.col("page_number").cast("bigint")).union(
        pages.select("job_id", F.col("page_number") * 2)
    )
    return transitions.prioritize_pages(pages, requests, bind(spark, root, "jobs"))


@query(
    "retry_failed",
    """
    SELECT p.job_id, p.page_number, 'queued' AS status, CAST(0 AS INTEGER) AS attempts FROM [[job_pages]] p
    WHERE p.status IN ('failed', 'cancelled')
      AND p.job_id IN (SELECT job_id FROM [[jobs]] WHERE status NOT IN ('queued', 'running', 'cancelling'))
    """,
)
def _(spark, root):
    return transitions.retry_failed(bind(spark, root, "jobs"), bind(spark, root, "job_pages"))


@query(
    "recover_interrupted",
    """
    SELECT job_id, cancel_requested,
           CASE WHEN status = 'cancelling' OR (status IN ('queued', 'running') AND cancel_requested) THEN 'cancelled'
                WHEN status IN ('queued', 'running') THEN 'queued' ELSE status END AS status
    FROM [[jobs]]
    """,
)
def _(spark, root):
    return transitions.recover_interrupted(bind(spark, root, "jobs").drop("num_pages"))


@query(
    "recover_interrupted_pages",
    """
    SELECT p.job_id, p.page_number,
           CASE WHEN (j.status = 'cancelling' OR j.cancel_requested) AND p.status IN ('queued', 'running') THEN 'cancelled'
                WHEN j.status IN ('queued', 'running') AND NOT j.cancel_requested AND p.status = 'running' THEN 'queued'
                ELSE p.status END AS status,
           CASE WHEN (j.status = 'cancelling' OR j.cancel_requested) AND p.status IN ('queued', 'running')
                  THEN coalesce(p.error, 'Cancelled before application restart')
                WHEN j.status IN ('queued', 'running') AND NOT j.cancel_requested AND p.status = 'running'
                  THEN 'Resumed after application restart' ELSE p.error END AS error
    FROM [[job_pages]] p JOIN [[jobs]] j ON p.job_id = j.job_id
    """,
)
def _(spark, root):
    pages = bind(spark, root, "job_pages").select("job_id", "page_number", "status", "error")
    return transitions.recover_interrupted_pages(bind(spark, root, "jobs"), pages)


@query(
    "cancel_jobs",
    """
    WITH c AS (SELECT DISTINCT user_id AS job_id FROM {events} WHERE event_type = 'error' AND value > 100)
    SELECT j.job_id, j.cancel_requested OR c.job_id IS NOT NULL AS cancel_requested,
           CASE WHEN c.job_id IS NOT NULL AND j.status IN ('queued', 'running') THEN 'cancelling' ELSE j.status END AS status
    FROM [[jobs]] j LEFT JOIN c ON j.job_id = c.job_id
    """,
)
def _(spark, root):
    cancels = table(spark, root, "events").where("event_type = 'error' AND value > 100").select(
        F.col("user_id").alias("job_id")
    )
    return transitions.cancel_jobs(bind(spark, root, "jobs").drop("num_pages"), cancels)


@query(
    "finish_cancelled_pages",
    """
    SELECT p.job_id, p.page_number,
           CASE WHEN j.status = 'cancelling' AND p.status = 'queued' THEN 'cancelled' ELSE p.status END AS status
    FROM [[job_pages]] p JOIN [[jobs]] j ON p.job_id = j.job_id
    """,
)
def _(spark, root):
    pages = bind(spark, root, "job_pages").select("job_id", "page_number", "status")
    return transitions.finish_cancelled_pages(bind(spark, root, "jobs"), pages)


@query(
    "start_jobs",
    """
    SELECT j.job_id, cancel_requested, CASE WHEN status = 'queued' THEN 'running' ELSE status END AS status,
           CASE WHEN status = 'queued' THEN s.started_at END AS started_at
    FROM [[jobs]] j JOIN (SELECT user_id AS job_id, min(ts) AS started_at FROM {events} GROUP BY user_id) s ON j.job_id = s.job_id
    """,
)
def _(spark, root):
    started = table(spark, root, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("started_at"))
    jobs = bind(spark, root, "jobs").drop("num_pages").withColumn("started_at", F.lit(None).cast("timestamp_ntz"))
    return transitions.start_jobs(jobs, started)


@query(
    "mark_pages",
    """
    SELECT job_id, page_number, arg_max(status, (ts, event_id)) AS status,
           CASE WHEN arg_max(status, (ts, event_id)) = 'failed' THEN 'upstream' END AS error,
           CAST(arg_max(duration_ms, (ts, event_id)) FILTER (duration_ms IS NOT NULL) AS VARCHAR) AS duration_ms,
           CAST(count(*) FILTER (status = 'running') AS BIGINT) AS attempts,
           max(ts) FILTER (status = 'running') AS started_at,
           max(ts) FILTER (status IN ('completed', 'failed', 'cancelled')) AS finished_at,
           CAST(CASE WHEN count(*) FILTER (status = 'running') > 0 THEN 0 ELSE 1000 END AS INTEGER) AS priority,
           CASE WHEN arg_max(status, (ts, event_id)) = 'failed' THEN 'upstream_503' END AS error_code,
           arg_max(CASE WHEN event_id % 2 = 0 THEN 'realtime' ELSE 'batch' END, (ts, event_id)) AS processing_mode,
           arg_max(concat('batch-', event_id % 9), (ts, event_id)) FILTER (event_id % 2 = 1) AS remote_batch_id
    FROM [[status_events]] GROUP BY job_id, page_number
    """,
)
def _(spark, root):
    odd = F.col("event_id") % 2 == 1
    events = bind(spark, root, "status_events").withColumns({
        "error_code": F.when(F.col("status") == "failed", "upstream_503"),
        "processing_mode": F.when(odd, "batch").otherwise("realtime"),
        "remote_batch_id": F.when(odd, F.concat(F.lit("batch-"), F.col("event_id") % 9)),
    })
    blank = events.select("job_id", "page_number").distinct().select(
        "*", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("bigint").alias("duration_ms"), F.lit(0).alias("attempts"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.lit(1000).alias("priority"), *[F.lit(None).cast("string").alias(c) for c in ("error_code", "processing_mode", "remote_batch_id")],
    )
    return transitions.mark_pages(blank, events).withColumn("duration_ms", F.col("duration_ms").cast("string"))


@query(
    "job_eta",
    """
    WITH s AS (
      SELECT job_id, CAST(count(*) FILTER (status = 'queued') AS BIGINT) * 100 AS pending_pages,
             CAST(job_id % 24 AS INTEGER) AS concurrency, avg(duration_seconds) AS latency,
             CASE WHEN job_id % 3 = 0 THEN 1.5e0 END AS observed_rate,
             CASE WHEN job_id % 4 > 0 THEN (job_id % 4) / 10e0 END AS batch_seconds_per_page
      FROM [[job_pages]] GROUP BY job_id),
    r AS (SELECT *, least(1250 * 88e-2 / 60, greatest(1, concurrency) / greatest(5e-2, latency)) AS calc FROM s),
    e AS (SELECT *, pending_pages / greatest(1e-2, least(calc, coalesce(observed_rate, calc))) AS rt,
                 5 + pending_pages * batch_seconds_per_page AS bt FROM r)
    SELECT job_id, pending_pages, round(rt, 4) AS realtime_seconds, round(bt, 4) AS batch_seconds,
           CASE WHEN pending_pages >= 500 AND bt < rt * 9e-1 THEN 'batch' ELSE 'realtime' END AS mode
    FROM e
    """,
)
def _(spark, root):
    job = F.col("job_id")
    jobs = bind(spark, root, "job_pages").groupBy("job_id").agg(
        (F.count_if(F.col("status") == "queued") * 100).alias("pending_pages"),
        F.avg("duration_seconds").alias("latency"),
    ).select(
        "*", (job % 24).cast("int").alias("concurrency"),
        F.when(job % 3 == 0, 1.5).alias("observed_rate"),
        F.when(job % 4 > 0, (job % 4) / F.lit(10.0)).alias("batch_seconds_per_page"),
    )
    return transitions.job_eta(jobs).select(
        "job_id", "pending_pages", F.round("realtime_seconds", 4).alias("realtime_seconds"),
        F.round("batch_seconds", 4).alias("batch_seconds"), "mode",
    )


_ERRORS = """
    SELECT event_id, CAST(CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 500 + user_id % 100
                          WHEN 'click' THEN 400 + user_id % 100 END AS INTEGER) AS status_code,
           CASE WHEN event_type = 'purchase' THEN
                  CASE event_id % 3 WHEN 0 THEN 'Read Timed Out' WHEN 1 THEN 'Too Many Requests' ELSE 'odd' END
                WHEN event_type = 'click' AND event_id % 5 = 0 THEN 'connection reset by peer' ELSE '' END AS error,
           CAST(JSON_K(props) % 5 + 1 AS INTEGER) AS attempt,
           CASE WHEN event_id % 4 = 0 THEN value - 10 END AS retry_after
    FROM {events}
"""
_CLASSIFIED = f"""
    SELECT *, CASE WHEN status_code = 429 OR contains(lower(error), 'too many requests') THEN 'rate_limited'
                   WHEN status_code BETWEEN 500 AND 599 THEN concat('upstream_', status_code)
                   WHEN contains(lower(error), 'timed out') OR contains(lower(error), 'connection reset') THEN 'transient_network'
                   WHEN status_code BETWEEN 400 AND 499 THEN concat('request_', status_code)
                   ELSE 'ocr_error' END AS error_code FROM ({_ERRORS})
"""


def _errors(spark, root):
    text = _ERRORS.replace("JSON_K(props)", "CAST(get_json_object(props, '$.k') AS INT)")
    return transitions.classify_errors(spark.sql(text, events=table(spark, root, "events")))


@query(
    "classify_errors",
    f"""
    SELECT event_id, error_code, error_code = 'rate_limited' AS rate_limited,
           error_code = 'rate_limited' OR error_code = 'transient_network' OR starts_with(error_code, 'upstream_') AS retryable
    FROM ({_CLASSIFIED})
    """,
)
def _(spark, root):
    return _errors(spark, root).select("event_id", "error_code", "rate_limited", "retryable")


@query(
    "retry_plan",
    f"""
    SELECT event_id, attempt, attempt < 3 AND retryable AS retry,
           CASE WHEN attempt < 3 AND retryable THEN round(coalesce(
             CASE WHEN retry_after IS NOT NULL THEN greatest(0e0, retry_after) END,
             least(8e0, 5e-1 * pow(2, attempt - 1))), 6) END AS delay_seconds
    FROM (SELECT *, error_code = 'rate_limited' OR error_code = 'transient_network'
                    OR starts_with(error_code, 'upstream_') AS retryable FROM ({_CLASSIFIED}))
    """,
)
def _(spark, root):
    plan = transitions.retry_plan(_errors(spark, root))
    return plan.select("event_id", "attempt", "retry", F.round("delay_seconds", 6).alias("delay_seconds"))


def _shout(document: int, page: int, markdown: str) -> str:
    """Deterministic stand-in for a page model: fails on some pages by their number."""
    if (document + page) % 9 == 0:
        raise ValueError("page unreadable")
    return f"{document}/{page}:{markdown.count(' ')}:{len(markdown)}"


@query(
    "process_pages",
    """
    SELECT document_id, page_number,
           CASE WHEN (document_id + page_number) % 9 <> 0 THEN concat(document_id, '/', page_number, ':',
                length(markdown) - length(replace(markdown, ' ', '')), ':', length(markdown)) END AS result,
           CASE WHEN (document_id + page_number) % 9 = 0 THEN 'page unreadable' END AS error,
           CAST(CASE WHEN (document_id + page_number) % 9 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts
    FROM [[doc_pages]]
    """,
)
def _(spark, root):
    return userfuncs.process_pages(
        bind(spark, root, "doc_pages", heavy=True), _shout, retryable=lambda error: isinstance(error, ValueError)
    )


def _batch_lengths(pages: list[int], texts: list[str]) -> dict:
    """Deterministic stand-in for a batch model: errors and gaps for some pages."""
    out = {}
    for page, text in zip(pages, texts, strict=True):
        if text.endswith("00"):
            out[page] = ValueError("bad page")
        elif not text.endswith("7"):
            out[page] = f"{page}:{len(pages)}:{text}"
    return out


@query(
    "process_batches",
    """
    WITH q AS (SELECT job_id, page_number, CAST(floor(duration_seconds * 100 + 5e-1) AS BIGINT) AS cents,
                 CAST((row_number() OVER (PARTITION BY job_id ORDER BY priority DESC, page_number) - 1) // 8 AS BIGINT) AS batch_number
               FROM [[job_pages]] WHERE status = 'queued'),
    n AS (SELECT *, CAST(cents AS VARCHAR) AS t, count(*) OVER (PARTITION BY job_id, batch_number) AS size FROM q)
    SELECT job_id, page_number, batch_number,
           CASE WHEN NOT ends_with(t, '00') AND NOT ends_with(t, '7') THEN concat(page_number, ':', size, ':', t) END AS result,
           CASE WHEN ends_with(t, '00') THEN 'bad page' WHEN ends_with(t, '7') THEN 'No batch result returned' END AS error
    FROM n
    """,
)
def _(spark, root):
    pages = bind(spark, root, "job_pages").withColumn(
        "markdown", F.floor(F.col("duration_seconds") * 100 + 0.5).cast("string")
    )
    return userfuncs.process_batches(pages, _batch_lengths)
