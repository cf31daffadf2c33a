"""Streams end by themselves, go on from their checkpoints, and give what the batch operators give."""

import datetime
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import jobs
from quire.plans import queries, review
from quire.streaming import events

SF = "/root/testdata/sf0.001"


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def part(src, path, name, remainder):
    """A file of the log, in no order."""
    src.where(F.pmod(F.xxhash64("event_id"), F.lit(4)).isin(remainder)).coalesce(1).write.parquet(f"{path}/{name}")


@pytest.fixture
def source(spark):
    return spark.read.parquet(f"{SF}/events.parquet")


def marker(spark, source, ts):
    """An event of a job of its own, which tells that the log has gone on."""
    return spark.createDataFrame([(10**9, ts, 10**9, "view", 0.0, "")], source.schema)


def test_limiter_restarts_and_equals_the_batch(spark, source, tmp_path):
    part(source, tmp_path / "in", "a", [0, 1])
    stream = events.log(spark, str(tmp_path / "in/*"), files_per_trigger=1)
    run = lambda: events.written(events.limited(stream, 2, 40, 21600, late="60 days"), str(tmp_path / "out"), str(tmp_path / "c"))
    run()
    assert spark.read.schema(events.LIMITED).parquet(str(tmp_path / "out")).count() == 0  # all wait: the log hasn't gone on by 60 days
    part(source, tmp_path / "in", "b", [2])
    part(source, tmp_path / "in", "c", [3])
    run()
    marker(spark, source, datetime.datetime(2024, 6, 1)).write.parquet(str(tmp_path / "in/d"))
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert values(got, "event_id", "delay") == values(queries.rate_limit_windows(spark, SF), "event_id", "delay")


def state(spark, checkpoint, name):
    return spark.read.format("statestore").option("path", str(checkpoint)).option("stateVarName", name).load()


def test_limiter_forgets_idle_jobs_and_late_requests(spark, source, tmp_path):
    day = datetime.datetime(2024, 3, 1)
    row = lambda i, user, minutes: (i, day + datetime.timedelta(minutes=minutes), user, "view", 1.0, "")
    put = lambda name, *rows: spark.createDataFrame(rows, source.schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = events.log(spark, str(tmp_path / "in/*"), files_per_trigger=1)
    run = lambda: events.written(events.limited(stream, 1, 100, 3600, late="10 minutes"), str(tmp_path / "out"), str(tmp_path / "c"))
    put("a", row(1, 7, 0), row(2, 7, 1), row(3, 8, 30))
    run()
    assert values(spark.read.parquet(str(tmp_path / "out")), "event_id", "delay") == [(1, 0), (2, 3540)]
    assert [r["key"]["user_id"] for r in state(spark, tmp_path / "c", "use").collect()] == [7]
    put("b", row(4, 7, 2), row(5, 8, 25), row(6, 9, 300))  # the first is late by more than ten minutes, the second isn't
    run()
    assert values(spark.read.parquet(str(tmp_path / "out")), "event_id", "delay") == [(1, 0), (2, 3540), (3, 3300), (5, 0)]
    put("c", row(7, 9, 301))
    run()
    assert state(spark, tmp_path / "c", "use").where("key.user_id IN (7, 8)").count() == 0  # their windows are over


def test_statuses_equal_the_folded_log(spark, source, tmp_path):
    for i in range(4):
        part(source, tmp_path / "in", f"p{i}", [i])
    log = lambda e: e.select(F.col("user_id").alias("job"), "event_id", "ts", review.kind_of(F.col("event_type")).alias("type"))
    stream = log(events.log(spark, str(tmp_path / "in/*"), files_per_trigger=1))
    run = lambda: events.gathered(events.statuses(stream, "job", "event_id", "type", most=3, late="60 days"), str(tmp_path / "out"), str(tmp_path / "c"))
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    last = got.groupBy("job").agg(F.max_by(F.struct("status", "stage", "events", "tail"), "events").alias("s")).select("job", "s.*")
    want = jobs.folded_status(log(source), "job", "event_id", "type")
    assert values(last, "job", "status", "stage", "events") == values(want, "job", "status", "stage", "events") == values(review.job_status(spark, SF), "job", "status", "stage", "events")
    tails = {r["user_id"]: r["ids"][-3:] for r in source.groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids")).collect()}
    assert {r["job"]: r["tail"] for r in last.collect()} == tails
    assert state(spark, tmp_path / "c", "fold").count() == len(tails)
    marker(spark, source, datetime.datetime(2024, 8, 1)).write.parquet(str(tmp_path / "in/d"))
    run()
    assert {r["key"]["job"] for r in state(spark, tmp_path / "c", "fold").collect()} == {10**9}  # all others have been silent


def test_windows_and_latest(spark, source, tmp_path):
    source.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = events.log(spark, str(tmp_path / "in"))
    for name, df in (("latest_jobs", events.latest(stream)), ("windows", events.windowed(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert values(spark.table("latest_jobs"), "user_id", "stage", "events") == values(queries.jobs_latest(spark, SF), "user_id", "stage", "events")
    hours = source.groupBy(F.date_trunc("hour", "ts").cast("timestamp").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.floor("value")).alias("tokens"))
    assert values(spark.table("windows"), "start", "event_type", "requests", "tokens") == values(hours, "start", "event_type", "requests", "tokens")


def test_streamed_queries_of_many_files(spark, source, tmp_path):
    source.repartition(20, "event_id").write.parquet(str(tmp_path / "events.parquet"))  # more than a stream takes at a time
    got = review.stream_rate_limits(spark, str(tmp_path))
    assert values(got, "event_id", "delay") == values(queries.rate_limit_windows(spark, SF), "event_id", "delay")
    assert values(review.stream_job_status(spark, str(tmp_path)), "job", "events") == values(queries.jobs_latest(spark, SF).withColumnRenamed("user_id", "job"), "job", "events")


def test_limiter_asks_its_state_by_job_not_by_request():
    """A job's thousand requests: one chunk, one timer, and one answer when the watermark has passed them."""
    calls = []

    class State:
        held = []

        def appendValue(self, value):
            calls.append("append")
            self.held.append(value)

        def get(self):
            calls.append("get")
            return iter(self.held)

        clear = lambda self: calls.append("clear")
        registerTimer = lambda self, at: calls.append("timer")

    class Value:
        get = lambda self: calls.append("get")
        clear = lambda self: calls.append("clear")

    limiter = events._Limiter(2, 40, 60)
    limiter.handle = limiter.waiting = State()
    limiter.use = Value()
    frame = pd.DataFrame({"at": range(1000), "event_id": range(1000), "tokens": 1})
    assert not list(limiter.handleInputRows((7,), iter([frame]), None))
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9, getExpiryTimeInMs=lambda: 1000)
    out = list(limiter.handleExpiredTimer((7,), times, times))
    assert len(out) == 1 and len(out[0]) == 1000 and len(calls) <= 8
