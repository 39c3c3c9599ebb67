"""Streams over several files arriving in order, compared with the batch result."""

import pytest
from pyspark.sql import functions as F

from quire.functions.ranking import minute_of
from quire.operators import aggregates
from quire.operators.search import inverted_index
from quire.plans.registry import bind
from quire.streaming import streams


def in_files(spark, df, order, path, n=4):
    """The rows as n files in order, read one per micro-batch."""
    total = df.count()
    numbered = df.orderBy(order).coalesce(1).withColumn("_i", F.monotonically_increasing_id())
    for i in range(n):
        part = numbered.where((F.col("_i") >= i * total // n) & (F.col("_i") < (i + 1) * total // n))
        part.drop("_i").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ewma_across_batches_and_restart(spark, root, tmp_path):
    samples = bind(spark, root, "job_pages").select("job_id", "duration_seconds", "ts", "event_id")
    stream = in_files(spark, samples, "event_id", str(tmp_path / "in"))
    streams.stream_latency_ewma(spark, stream, str(tmp_path / "w"), "job_id", "duration_seconds")
    again = streams.stream_latency_ewma(spark, stream, str(tmp_path / "w"), "job_id", "duration_seconds")
    got = {r["job_id"]: r["ewma"] for r in again.collect()}
    want = aggregates.latency_ewma(samples, "job_id", "duration_seconds", minute_of(F.col("ts")), [F.desc("ts"), F.desc("event_id")])
    for row in want.collect():
        assert got[row["job_id"]] == pytest.approx(row["ewma"])


def test_ewma_of_batches_in_any_order(spark, root, tmp_path):
    """Minutes torn over batches that arrive newest first and mixed, in two runs, equal the batch result."""
    samples = bind(spark, root, "job_pages").select(
        (F.col("job_id") % 3).alias("job_id"), "duration_seconds", F.date_trunc("hour", "ts").alias("ts"), "event_id"
    )
    newest_first = in_files(spark, samples.where("event_id % 3 > 0"), F.desc("event_id"), str(tmp_path / "in"), n=3)
    streams.stream_latency_ewma(spark, newest_first, str(tmp_path / "w"), "job_id", "duration_seconds")
    in_files(spark, samples.where("event_id % 3 = 0"), F.hash("event_id"), str(tmp_path / "in"), n=3)
    got = streams.stream_latency_ewma(spark, newest_first, str(tmp_path / "w"), "job_id", "duration_seconds")
    want = aggregates.latency_ewma(samples, "job_id", "duration_seconds", minute_of(F.col("ts")), [F.desc("ts"), F.desc("event_id")])
    pairs = got.join(want.select("job_id", F.col("ewma").alias("want"), F.col("samples").alias("n")), "job_id").collect()
    assert len(pairs) == 3
    for row in pairs:
        assert row.ewma == pytest.approx(row.want) and row.samples == row.n


def test_latest_status_over_batches_and_restart(spark, root, tmp_path):
    events = bind(spark, root, "status_events")
    early, late = events.where("event_id % 3 <> 0"), events.where("event_id % 3 = 0")
    stream = in_files(spark, early, "event_id", str(tmp_path / "in"))
    got = streams.stream_latest_status(spark, stream, str(tmp_path / "w"))
    want = sorted(map(tuple, streams.latest_status(early).collect()))
    assert sorted(map(tuple, got.collect())) == want
    # nothing new: the state stays; then older events arrive behind newer ones
    assert sorted(map(tuple, streams.stream_latest_status(spark, stream, str(tmp_path / "w")).collect())) == want
    in_files(spark, late.unionByName(early.limit(20)), F.desc("event_id"), str(tmp_path / "in"), n=2)
    got = streams.stream_latest_status(spark, stream, str(tmp_path / "w"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.latest_status(events).collect()))
    assert got.count() == got.select("job_id", "page_number").distinct().count()


def test_replay_of_a_batch(spark, root, tmp_path):
    """A batch whose commit is lost runs again and changes nothing."""
    events = bind(spark, root, "status_events")
    stream = in_files(spark, events, "event_id", str(tmp_path / "in"), n=3)
    want = sorted(map(tuple, streams.stream_latest_status(spark, stream, str(tmp_path / "w")).collect()))
    commits = sorted((tmp_path / "w/checkpoint/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    again = streams.stream_latest_status(spark, stream, str(tmp_path / "w"))
    assert sorted(map(tuple, again.collect())) == want == sorted(map(tuple, streams.latest_status(events).collect()))


def test_latest_status_of_nothing(spark, root, tmp_path):
    empty = bind(spark, root, "status_events").limit(0)
    empty.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(empty.schema).parquet(str(tmp_path / "in"))
    assert streams.stream_latest_status(spark, stream, str(tmp_path / "w")).count() == 0


def test_index_follows_changes_and_deletes(spark, tmp_path):
    schema = "document_id int, page_number int, markdown string, seq int"
    changes = spark.createDataFrame(
        [(1, 1, "old words", 1), (1, 2, "stay", 2), (1, 1, "new words", 3), (2, 1, "gone", 4), (2, 1, None, 5), (3, 1, "x y", 6)], schema
    )
    stream = in_files(spark, changes, "seq", str(tmp_path / "in"), n=6).drop("seq")
    got = streams.stream_index_update(spark, stream, str(tmp_path / "w"))
    final = spark.createDataFrame([(1, 1, "new words"), (1, 2, "stay"), (3, 1, "x y")], "document_id int, page_number int, markdown string")
    columns = ["token", "document_id", "page_number", "tf", "dl"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, inverted_index(final).select(columns).collect()))


def test_progress_over_batches(spark, root, tmp_path):
    events = bind(spark, root, "status_events")
    got = streams.stream_job_progress(spark, in_files(spark, events, "event_id", str(tmp_path / "in")), str(tmp_path / "w"))
    want = aggregates.job_rollup(streams.latest_status(events)).select("job_id", "total_pages")
    assert {r["job_id"]: r["total"] for r in got.collect()} == {r["job_id"]: r["total_pages"] for r in want.collect()}


def test_repeated_changes_inside_a_batch(spark, tmp_path):
    schema = "document_id int, page_number int, markdown string, seq int"
    changes = spark.createDataFrame([(1, 1, "old words", 1), (1, 1, "new", 2), (2, 1, "gone", 3), (2, 1, None, 4)], schema)
    got = streams.stream_index_update(spark, in_files(spark, changes, "seq", str(tmp_path / "in"), n=1), str(tmp_path / "w"), "seq")
    assert [(r.token, r.document_id) for r in got.collect()] == [("new", 1)]


def test_every_row_counts_in_its_window(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:30", i) for i, m in enumerate((0, 1, 40, 45, 0, 50))]
    pages = spark.createDataFrame(rows, "t string, i int").select(F.col("t").cast("timestamp").alias("ts"), "i")
    stream = in_files(spark, pages, "i", str(tmp_path / "in"), n=6)
    got = streams.stream_rate_windows(spark, stream, str(tmp_path / "w"))
    assert sorted(r["pages"] for r in got.collect()) == [1, 1, 1, 1, 2]


def test_claims_over_batches(spark, tmp_path):
    """Winners by (time, owner) in each period, also where an earlier claim comes a batch later; one that comes
    after its period has passed counts no more."""
    rows = [
        (1, "b", "10:05:00"), (1, "c", "10:04:00"), (2, "z", "10:30:00"), (3, "m", "10:00:00"),
        (1, "a", "10:04:00"), (2, "y", "10:30:00"), (2, "k", "10:59:59"), (1, "late", "11:10:00"),
        (4, "n", "14:00:00"), (1, "d", "14:00:01"), (4, "o", "14:00:00"), (4, "p", "13:59:00"),
        (5, "s", "14:00:00"), (5, "t", "14:05:00"), (5, "u", "14:10:00"), (5, "v", "14:15:00"),
        (1, "gone", "10:00:00"), (4, "q", "14:00:00"), (3, "gone", "09:00:00"), (4, "r", "14:30:00"),
    ]
    claims = spark.createDataFrame([(d, 1, o, i, f"2024-01-01 {t}") for i, (d, o, t) in enumerate(rows)], "document_id int, page_number int, owner_token string, i int, t string")
    claims = claims.withColumn("claimed_at", F.col("t").cast("timestamp")).drop("t")
    stream = in_files(spark, claims, "i", str(tmp_path / "in"), n=5)
    for _ in range(2):  # the second run has nothing to add
        got = streams.stream_claims(spark, stream, str(tmp_path / "w"), "1 hour")
        won = sorted((f"{r.period:%H}", r.document_id, r.owner_token) for r in got.collect())
        assert won == [("10", 1, "a"), ("10", 2, "y"), ("10", 3, "m"), ("11", 1, "late"), ("13", 4, "p"), ("14", 1, "d"), ("14", 4, "n"), ("14", 5, "s")]
    held = spark.read.format("statestore").load(str(tmp_path / "w/checkpoint")).select("key.window.start").distinct().collect()
    assert {f"{r.start:%H}" for r in held} <= {"13", "14"}


def test_claims_of_one_batch_are_read_without_a_shuffle(spark, tmp_path):
    rows = [(d % 7, d % 3, "o%02d" % (d * 37 % 50), f"2026-03-01 {10 + d % 4}:{d % 60:02d}:00") for d in range(200)]
    claims = spark.createDataFrame(rows, "document_id int, page_number int, owner_token string, at string")
    claims = claims.select("document_id", "page_number", "owner_token", F.col("at").cast("timestamp").alias("claimed_at"))
    claims.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(claims.schema).parquet(str(tmp_path / "in"))
    got = streams.stream_claims(spark, stream, str(tmp_path / "w"), "1 hour")
    want = {}
    for d, p, owner, at in rows:
        want[(at[11:13], d, p)] = min(want.get((at[11:13], d, p), (at, owner)), (at, owner))
    assert sorted((f"{r.period:%H}", r.document_id, r.page_number, f"{r.claimed_at:%Y-%m-%d %H:%M:%S}", r.owner_token) for r in got.collect()) == sorted(
        (*key, at, owner) for key, (at, owner) in want.items()
    )
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
