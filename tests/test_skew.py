"""One key holding most rows must be split, and must not change results."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions.ranking import minute_of, number_rows, ordered_rows
from quire.functions.skew import attach, flag_first
from quire.operators import joins, transitions
from quire.operators.aggregates import latency_ewma

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def tight(spark):
    """Thresholds at which test-sized data counts as skewed, and nothing is broadcast."""
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot(spark, n=60000):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500)
    return spark.range(0, n, 1, 8).select(key.alias("k"), F.col("id").alias("document_id"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_attach_splits_the_hot_key(tight):
    rows = hot(tight)
    totals = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = attach(rows, totals, ["k"])
    assert "skew=true" in final_plan(joined)
    assert joined.count() == 60000 and joined.where("k = 7").select("n").distinct().count() == 1


def test_duplicate_uploads_of_one_file(tight):
    rows = hot(tight).select("document_id", F.lit("s").alias("session_id"), F.col("k").cast("string").alias("checksum"), "pad")
    found = joins.find_duplicate_upload(rows, rows)
    assert "skew=true" in final_plan(found)
    assert found.select("stored_id").distinct().count() == found.select("checksum").distinct().count()


def test_pages_of_one_huge_job(tight):
    pages = hot(tight).select(F.col("k").alias("job_id"), F.col("document_id").alias("page_number"), F.lit("queued").alias("status"), F.col("pad").alias("error"))
    jobs = pages.groupBy("job_id").agg(F.lit("cancelling").alias("status"))
    stopped = transitions.finish_cancelled_pages(jobs, pages)
    assert "skew=true" in final_plan(stopped)
    assert stopped.where("status = 'cancelled'").count() == 60000


def test_attach_keeps_sql_null_keys_apart(spark):
    left = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    right = spark.createDataFrame([(None, 9), (2, 8)], "k int, w int")
    assert sorted((r["v"], r["w"]) for r in attach(left, right, ["k"]).collect()) == [(1, None), (2, 8)]
    assert attach(left, right, ["k"], "left_anti").count() == 1


def test_first_of_a_hot_key(spark):
    rows = hot(spark, 9000).select("k", "document_id")
    flagged = flag_first(rows, ["k"], [F.col("document_id")], ["document_id"])
    got = {r["k"]: r["document_id"] for r in flagged.where("is_first").collect()}
    want = {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.min("document_id").alias("m")).collect()}
    assert got == want and flagged.count() == 9000


def test_half_of_all_rows_in_one_minute(spark):
    """Rows of one key and minute are numbered in as many tasks as their number needs."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 40_000
        events = spark.range(n).select(
            F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("event_id"), F.lit(2.0).alias("value"),
            F.timestamp_seconds(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") * 60)).alias("ts"),
        )
        order = [F.asc("ts"), F.asc("event_id")]
        tasks = sorted(r["count"] for r in ordered_rows(events, ["k"], order).groupBy(F.shiftright("_at", 33).alias("task")).count().collect())
        assert sum(tasks) == n and len(tasks) >= 4 and tasks[-1] <= 2 * tasks[len(tasks) // 2]
        numbered = number_rows(events, ["k"], minute_of(F.col("ts")), order, "n")
        want = events.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
        assert numbered.select("k", "event_id", "n").exceptAll(want.select("k", "event_id", F.col("n").cast("bigint"))).count() == 0
        ewma = latency_ewma(events, "k", "value", minute_of(F.col("ts")), [F.desc("ts"), F.desc("event_id")])
        assert {round(r.ewma, 9) for r in ewma.collect()} == {2.0}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
