"""Incremental variants of the batch operators.

Stateful results are kept as change logs: every micro-batch is reduced first and written to a
folder named by its batch id, so a replayed batch overwrites itself (exactly once), a batch only
shuffles its own rows, and readers merge the log. Where a reader needs one row a key, the result is the
state of the stream itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quire.functions.ranking import minute_of
from quire.functions.skew import attach
from quire.operators.aggregates import PAGES_PER_MINUTE, TARGET_UTILIZATION, ewma_parts, ewma_value, merge_ewma
from quire.operators.joins import reject_stale
from quire.operators.segments import Index, update_index


def run_log(stream: DataFrame, reduce_batch: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Drain the stream, writing each reduced micro-batch to ``path/log/batch_id=<id>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        reduce_batch(batch).write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")

    drain(stream, write, path)


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], path: str) -> None:
    query = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All batches with their numeric ``batch_id``."""
    return spark.read.parquet(f"{path}/log").withColumn("batch_id", F.col("batch_id").cast("bigint"))


def latest_status(events: DataFrame) -> DataFrame:
    """Newest status per (job_id, page_number); also merges already reduced logs."""
    newest = F.max(F.struct("ts", "event_id", "status")).alias("_last")
    return events.groupBy("job_id", "page_number").agg(newest).select(
        "job_id", "page_number", "_last.status", "_last.ts", "_last.event_id"
    )


def stream_latest_status(spark: SparkSession, events: DataFrame, path: str) -> DataFrame:
    """Newest event of each (job, page) over all batches, one row a key.

    The newest event is the state of a streaming aggregation: batches are combined before their shuffle, so
    that a page with very many events costs one row a task, and each batch touches the state of its own keys only.
    Events may come late and in any order. The table is read from the state after the last finished batch; a
    restart goes on from there, and a replayed batch starts from the state before it.
    """
    newest = F.max(F.struct("ts", "event_id", "status")).alias("_last")
    query = (
        events.groupBy("job_id", "page_number").agg(newest).writeStream.outputMode("update").format("noop")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.lastProgress is None and not _has_state(spark, path):
        return latest_status(spark.createDataFrame([], events.schema))
    state = spark.read.format("statestore").load(f"{path}/checkpoint")
    (held,) = state.schema["value"].dataType.names
    return state.select("key.*", F.col(f"value.{held}").alias("_last")).select(
        "job_id", "page_number", "_last.status", "_last.ts", "_last.event_id"
    )


def _has_state(spark: SparkSession, path: str) -> bool:
    """Whether a batch of the stream has been finished."""
    try:
        return bool(spark.read.format("state-metadata").load(f"{path}/checkpoint").head(1))
    except AnalysisException:
        return False


def stream_claims(spark: SparkSession, claims: DataFrame, path: str, horizon: str) -> DataFrame:
    """The winning claim of each page in each period of ``horizon``: the first by (claimed_at, owner_token).

    The best claim of a (period, page) is the state of a streaming aggregation, so a page that everyone claims
    costs one row a task, and state goes when the watermark, one horizon behind the newest claim, has passed its
    period; claims that come later than that count no more. Winners that a batch changes are logged with it, and
    the least of a page's logged winners is the one that stands, whatever the order of the batches. The log of a
    single batch is read as it is.
    """
    best = F.min(F.struct("claimed_at", "owner_token")).alias("_best")
    winners = claims.withWatermark("claimed_at", horizon).groupBy(F.window("claimed_at", horizon), "document_id", "page_number").agg(best)
    winners = winners.select(F.col("window.start").alias("period"), "document_id", "page_number", "_best")
    query = (
        winners.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    stand = read_log(spark, path)
    if stand.select("batch_id").distinct().count() > 1:  # a batch logs each page once
        stand = stand.groupBy("period", "document_id", "page_number").agg(F.min("_best").alias("_best"))
    return stand.select("period", "document_id", "page_number", "_best.owner_token", "_best.claimed_at")


def stream_rate_windows(
    spark: SparkSession, pages: DataFrame, path: str, target: float = PAGES_PER_MINUTE * TARGET_UTILIZATION
) -> DataFrame:
    """Pages per one-minute window against the target rate.

    Each micro-batch logs its own counts and the log is summed, so a window shows at once, late rows
    count in their window, and no state is held between batches.
    """

    def counts(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.window("ts", "1 minute").start.alias("window_start")).agg(F.count(F.lit(1)).alias("pages"))

    run_log(pages, counts, path)
    windows = read_log(spark, path).groupBy("window_start").agg(F.sum("pages").alias("pages"))
    return windows.withColumn("over_target", F.col("pages") > target)


def stream_latency_ewma(
    spark: SparkSession, samples: DataFrame, path: str, key: str, value: str, keep: float = 0.8
) -> DataFrame:
    """Running moving average per key (samples with ``ts`` and ``event_id``), whatever the order of the batches.

    Samples are logged by batch. For each (key, minute) that a batch touches, also one that was there before, the
    summary (n, s, first) is made again from all its samples so far and logged with the batch. The average composes
    the newest summaries of a key in the order of time: s = s1*keep**n2 + s2. A late batch so changes its own minutes
    only. A replayed batch writes the same folders again and reads no later ones.
    """
    newest = [F.desc("ts"), F.desc("event_id")]

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        timed = batch.select(key, value, "ts", "event_id").withColumn("minute", minute_of(F.col("ts")))
        timed.write.mode("overwrite").parquet(f"{path}/samples/batch_id={batch_id}")
        own = session.read.parquet(f"{path}/samples/batch_id={batch_id}")
        span = own.agg(F.min("minute").alias("low"), F.max("minute").alias("high")).first()
        known = session.read.parquet(f"{path}/samples").where(
            (F.col("batch_id") <= batch_id) & F.col("minute").between(F.lit(span.low), F.lit(span.high))
        )
        touched = own.select(key, "minute").distinct()
        due = known.join(touched, [key, "minute"], "left_semi")
        parts = ewma_parts(due, [key, "minute"], value, F.lit(0), newest, keep)
        parts.write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")

    drain(samples, write, path)
    latest = F.max(F.struct("batch_id", "n", "s", "first")).alias("_l")
    summaries = read_log(spark, path).groupBy(key, "minute").agg(latest).select(key, "minute", "_l.n", "_l.s", "_l.first")
    return ewma_value(merge_ewma(summaries, [key], "minute", keep), [key], keep)


def stream_job_progress(spark: SparkSession, events: DataFrame, path: str) -> DataFrame:
    """Done and total pages per job by each page's newest status (job_id, page_number, status, ts, event_id)."""
    newest = stream_latest_status(spark, events, path)
    done = F.col("status").isin("completed", "failed", "cancelled")
    return newest.groupBy("job_id").agg(F.count_if(done).alias("done"), F.count(F.lit(1)).alias("total"))


def stream_index_update(spark: SparkSession, changes: DataFrame, path: str, order: str | None = None) -> DataFrame:
    """Postings in step with page changes; null markdown deletes a page.

    Of several changes of one page in a batch the last by ``order``, a column of the changes, counts; without it
    a page changes at most once a batch. A batch becomes a segment of the stored index in ``path``, which marks
    the pages it replaces; only segments that a full size tier merges are written again.
    """
    drain(changes, lambda batch, batch_id: update_index(batch.sparkSession, path, batch, batch_id, order), path)
    return Index(spark, path).postings()


def stream_reject_stale(
    spark: SparkSession, results: DataFrame, documents: DataFrame, path: str, cancelled: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected results as two sinks of one stream-static join."""

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = reject_stale(batch, documents)
        if cancelled is not None:
            stopped = cancelled.select("job_id").distinct().withColumn("_stopped", F.lit(True))
            judged = attach(judged, stopped, ["job_id"]).withColumn(
                "reject_reason",
                F.coalesce("reject_reason", F.when(F.col("_stopped"), "job_cancelled")),
            ).drop("_stopped")
        judged.write.mode("overwrite").parquet(f"{path}/judged/batch_id={batch_id}")
        kept = spark.read.parquet(f"{path}/judged/batch_id={batch_id}")
        kept.where("reject_reason is null").drop("reject_reason").write.mode("overwrite").parquet(
            f"{path}/log/batch_id={batch_id}"
        )
        kept.where("reject_reason is not null").write.mode("overwrite").parquet(
            f"{path}/rejected/batch_id={batch_id}"
        )

    drain(results, write, path)
    return read_log(spark, path), spark.read.parquet(f"{path}/rejected")


def stream_ingest_files(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """Ledger of picked-up files with their rows; the checkpoint makes each file count once."""
    named = stream.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size"))
    run_log(
        named,
        lambda batch: batch.groupBy("file_name", "file_size").agg(F.count(F.lit(1)).alias("file_rows")),
        path,
    )
    return read_log(spark, path)

